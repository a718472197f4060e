"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model is compiled into three machines: the normaliser (the model's own character map, a trie of byte strings and what
they become, longest match first; white space taken together and escaped, one put before the text), the pieces as a trie
whose final states carry ids, and byte fallback (a character that no piece holds becomes its bytes' pieces). A text is
composed with them into a lattice, whose states are (place, last piece), and the shortest path is taken in the tropical
semiring. For a unigram model an arc weighs its piece's negative score. For a BPE model scores are priorities of merges,
not weights; there an arc weighs 0 if its piece and the one before keep apart under the merges (a memo holds what each
pair does) and infinity if not, so the one finite path is the path that merging takes.

No piece holds a character followed by an escaped space, nor a line feed, so texts are cut there without any effect on
the path. Chunks are found and told apart by vectorised hashes over many texts at once, so that each different chunk is
composed once, and what it gives is remembered (CACHE chunks at most, then all are forgotten). Whole texts are encoded.

Defined cases: a null text gives null ids, null count and null text back; an empty text gives no ids; repeated rows are
encoded each; an empty table gives an empty result; other columns are neither read nor returned by encode(). round_trip
says whether decoding gives the normalised text again (with the identity normaliser: the text).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_hash, release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE, CACHED_BYTES = 1 << 18, 64
INFINITE = float("inf")
#: Characters of text that are cut into chunks at once.
SLICE = 1 << 20


def load(path: str = MODEL) -> dict:
    """The parts of a model file that the machines need, as plain values (sent to executors once; bounded by the vocabulary)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("white space as a suffix is not supported")
    n = m.normalizer_spec
    return {"kind": m.trainer_spec.model_type, "pieces": [(p.piece, p.score, p.type) for p in m.pieces], "prefix": n.add_dummy_prefix, "escape": n.escape_whitespaces, "strip": n.remove_extra_whitespaces, "map": bytes(n.precompiled_charsmap)}


class CharacterMap:
    """A compiled map of byte strings: a double-array trie of 32-bit units, and what its values point to."""

    def __init__(self, data: bytes) -> None:
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.texts = data[4 + size :]
        plain = "".join(re.escape(chr(c)) for c in range(128) if self._plain(c))
        # characters that no key starts with; one before a character above 127 may be combined with it
        self.skip = re.compile(f"[{plain}]+(?![^\x00-\x7f])") if plain else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, at: int, c: int) -> int | None:
        at ^= c
        unit = self.units[at] if at < len(self.units) else 0
        return at if unit & 0x800000FF == c else None

    def _plain(self, c: int) -> bool:
        at = self._step(self._offset(self.units[0]), c)
        if at is None:
            return True
        unit = self.units[at]
        at ^= self._offset(unit)
        return not unit >> 8 & 1 and not any(self._step(at, d) is not None for d in range(128))

    def longest(self, data: bytes, begin: int) -> tuple[int, bytes] | None:
        """Length and image of the longest key at a place."""
        at, found = self._offset(self.units[0]), None
        for i in range(begin, len(data)):
            at = self._step(at, data[i])
            if at is None:
                break
            unit = self.units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - begin, self.units[at] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(0, found[1])])

    def __call__(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            if self.skip and (m := self.skip.match(text, i)):
                out.append(m[0])
                i = m.end()
                continue
            data = text[i : i + 64].encode("utf-8", "surrogatepass")  # no key is as long
            hit = self.longest(data, 0)
            if hit is None:
                out.append(text[i])
                i += 1
            else:
                out.append(hit[1].decode("utf-8", "surrogatepass"))
                i += len(data[: hit[0]].decode("utf-8", "surrogatepass"))
        return "".join(out)


class Transducer:
    def __init__(self, model: dict) -> None:
        self.bpe, self.prefix, self.escape, self.strip = model["kind"] == BPE, model["prefix"], model["escape"], model.get("strip", False)
        self.map = CharacterMap(model["map"]) if model.get("map") else None
        self.text = [p for p, _, _ in model["pieces"]]
        self.score = [s for _, s, _ in model["pieces"]]
        self.ids = {p: i for i, (p, _, t) in enumerate(model["pieces"]) if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model["pieces"]) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(model["pieces"]) if t == UNKNOWN), 0)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie  # character -> [id of the piece that ends here or None, next characters]
            for c in p[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(p[-1], [None, {}])[0] = i
        held = {c for p in self.ids for c in p}
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        cuts = "" if "\n" in held else "\n"
        self.cut_lines, self.whole = bool(cuts), inner or not self.escape
        self.chunks = re.compile(f"{cuts}|{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+" if cuts else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if not inner else lambda t: [t]
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.cache: dict[bytes, bytes] = {}
        raw = [self._bytes_of(i, t) for i, (_, _, t) in enumerate(model["pieces"])]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _bytes_of(self, i: int, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        if kind in (CONTROL, UNKNOWN):
            return b"" if kind == CONTROL else " ⁇ ".encode()
        return (self.text[i].replace(SPACE, " ") if self.escape else self.text[i]).encode()

    # ------------------------------------------------------------ the machines

    def mapped(self, text: str) -> str:
        """The text after the character map and the rules on white space, not yet escaped, without the space put before it."""
        if self.map:
            text = self.map(text)
        if self.strip:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def normalised(self, text: str) -> str:
        text = self.mapped(text)
        if not text:
            return text
        text = (" " if self.prefix else "") + text
        return text.replace(" ", SPACE) if self.escape else text

    def fallback(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Merging by priority, leftmost first among equals: what pairs of pieces do is read off this."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, last: int, piece: int) -> float:
        """Of the arc that takes `piece` after `last` (-1: nothing that could merge with it)."""
        if not self.bpe:
            return -self.score[piece]
        row = self.apart.get(last)
        if row is None:
            row = self.apart[last] = {}
        ok = row.get(piece)
        if ok is None:
            a, b = self.text[last] if last >= 0 else "", self.text[piece]
            if self.pairs >= 2 * CACHE:
                self.pairs, row = 0, {}
                self.apart.clear()
                self.apart[last] = row
            self.pairs += 1
            ok = row[piece] = self.merged(a + b) == ([a, b] if a else [b])
        return 0.0 if ok else INFINITE

    def path(self, s: str) -> list[int]:
        ids = self.single_path(s) if self.bpe else None
        return self.any_path(s) if ids is None else ids

    def single_path(self, s: str) -> list[int] | None:
        """The same where all weights are 0 or infinite and at most one finite path leads to each place; None if it is otherwise."""
        n, apart, trie, weight = len(s), self.apart, self.trie, self.weight
        at, back = [None] * (n + 1), [0] * (n + 1)
        at[0] = -1
        for i in range(n):
            last = at[i]
            if last is None:
                continue
            if last < -1:
                last = -1
            row, node, j = apart.get(last) or {}, trie, i
            while j < n:
                arc = node.get(s[j])
                if arc is None:
                    break
                j += 1
                piece, node = arc
                if piece is not None:
                    ok = row.get(piece)
                    if ok is None:
                        ok = weight(last, piece) == 0.0
                        row = apart[last]
                    if ok:
                        if at[j] is not None:
                            return None
                        at[j], back[j] = piece, i
            if at[i + 1] is None and (s[i] not in trie or trie[s[i]][0] is None):
                at[i + 1], back[i + 1] = -2, i
        if at[n] is None:
            return None
        out = []
        while n > 0:
            i = back[n]
            out.append([at[n]] if at[n] >= 0 else self.fallback(s[i:n]))
            n = i
        return [x for ids in reversed(out) for x in ids]

    def any_path(self, s: str) -> list[int]:
        """Shortest path through the composition of s with the pieces and byte fallback."""
        n, weight = len(s), self.weight
        # best[i]: last piece -> (distance, place before, last piece before); a unigram arc doesn't depend on the piece before it, so one state a place will do
        best: list[dict] = [{} for _ in range(n + 1)]
        best[0][-1] = (0.0, -1, -1)
        for i in range(n):
            states = best[i]
            if not states:
                continue
            if not self.bpe and len(states) > 1:
                least = min(states, key=lambda k: states[k][0])
                states = best[i] = {least: states[least]}
            node, j, single = self.trie, i, False
            while j < n:
                arc = node.get(s[j])
                if arc is None:
                    break
                j += 1
                piece, node = arc
                if piece is None:
                    continue
                single = single or j == i + 1
                ahead = best[j]
                for last, (d, _, _) in states.items():
                    w = d + weight(last if last >= 0 else -1, piece)
                    if w < INFINITE and (piece not in ahead or w < ahead[piece][0]):
                        ahead[piece] = (w, i, last)
            if not single:  # no piece is this character: bytes, which never merge
                d, last = min((v[0], k) for k, v in states.items())
                w, ahead = d - (0.0 if self.bpe else self.worst), best[i + 1]
                if -1 - ord(s[i]) not in ahead or w < ahead[-1 - ord(s[i])][0]:
                    ahead[-1 - ord(s[i])] = (w, i, last)
        if not best[n]:
            raise ValueError("no path")
        last, i, out = min((v[0], k) for k, v in best[n].items())[1], n, []
        while i > 0:
            _, before, previous = best[i][last]
            out.append([last] if last >= 0 else self.fallback(s[before:i]))
            i, last = before, previous
        return [x for ids in reversed(out) for x in ids]

    # ------------------------------------------------------------ batches

    def remembered(self, chunk: bytes) -> bytes:
        """Ids of a chunk (UTF-8, spaces not escaped), as 32-bit numbers."""
        ids = self.cache.get(chunk)
        if ids is None:
            s = chunk.decode("utf-8", "surrogatepass")
            ids = array("i", self.path(s.replace(" ", SPACE) if self.escape else s)).tobytes()
            if len(chunk) <= CACHED_BYTES:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[chunk] = ids
        return ids

    def encode_batch(self, mapped: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (as mapped() gives them), and where each text's begin (one more entry for the end)."""
        front = b" " if self.prefix else b""
        raw = [front + (t.replace(SPACE, " ") if self.escape else t).encode("utf-8", "surrogatepass") if t else b"" for t in mapped]
        text_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        body = b"".join(raw)
        data = np.frombuffer(body, np.uint8)
        begins = np.zeros(len(data), bool)
        begins[text_at[:-1][np.diff(text_at) > 0]] = True
        if not self.whole:
            space, line = data == 32, (data == 10) & self.cut_lines
            begins |= line
            begins[1:] |= (space[1:] & ~space[:-1]) | (line[:-1] & ~space[1:])
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(mapped) + 1, np.int64)
        code, different = pd.factorize(byte_hash(data, start, end))
        first = np.empty(len(different), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        found = [self.remembered(body[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist())]
        size = np.array([len(x) for x in found], np.int64) // 4
        at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(found), np.int32)
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - at[code], n)]
        bounds = ends[np.searchsorted(start, text_at)]
        if not self.bytes:  # unknown characters side by side are one unknown piece
            unknown = ids == self.unknown
            again = unknown & np.concatenate([[False], unknown[:-1]])
            again[bounds[:-1][np.diff(bounds) > 0]] = False
            ids, bounds = ids[~again], bounds - np.concatenate([[0], np.cumsum(again)])[bounds]
        return ids, bounds

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([self.mapped(text)])[0]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts' bytes: pieces and bytes joined, spaces restored, the one put before the text taken off."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.arange(ends[-1]) - np.repeat(ends[:-1] - self.at[ids], size)].tobytes()
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            t = data[ends[a] : ends[b]]
            out.append(t[1:] if (self.prefix or self.strip) and t[:1] == b" " else t)
        return out


def machine(held: dict) -> Transducer:
    """One transducer for a task, kept with the broadcast value until the task ends."""
    if "machine" not in held:
        held["machine"] = Transducer(held["model"])
    return held["machine"]


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, and round_trip: whether decoding gives the text again."""
    held = docs.sparkSession.sparkContext.broadcast({"model": load(path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = machine(held.value)
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for a, b in slices(texts, SLICE):
                part = [None if x is None else t.mapped(x) for x in texts[a:b]]
                ids, offsets = t.encode_batch([x or "" for x in part])
                null = np.array([x is None for x in part])
                back = t.decode_batch(ids, offsets)
                same = [None if x is None else y == x.encode("utf-8", "surrogatepass") for x, y in zip(part, back)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists, pa.array(np.diff(offsets), mask=null), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])
        held.value.pop("machine", None)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that are no UTF-8 become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast({"model": load(path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, lists = machine(held.value), batch.column(1).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            back = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(lists, t.decode_batch(ids, offsets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
