"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

A text is cut at special tokens and then into pre-tokens, as the tokenizer's library does; a pre-token's number of tokens doesn't
depend on what stands beside it. First tier: the numbers for the pre-tokens that are frequent in a bounded sample, in one packed table that is broadcast.
Second tier: what isn't there is encoded by the library in the worker and remembered in a bounded cache. The sample decides
only which tier answers, never the answer.

The classes of characters that the byte-level pattern needs (letters, numbers, spaces) are taken from the library: texts with characters that
another version of Unicode puts in another class are cut by explicit classes, all others by the classes of the regex module.

Tokenizers other than byte-level BPE go the same way with the library's own normaliser and pre-tokenizer; models of sentencepiece count whole texts.

Defined cases: a null or empty text has no bytes and no tokens; each row is counted for itself, with or without a doc_id; an empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

LIMIT = 512
#: Documents that the first tier is chosen from, about; entries of the first tier and of a worker's cache; longest pre-token remembered.
SAMPLE_DOCS, FREQUENT, CACHE, LONGEST = 20_000, 1 << 16, 1 << 18, 64
#: The byte-level pre-tokenizer's pattern with its classes left open.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!{T})|{S}+"
CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


def model_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> tuple[str, bytes]:
    """What kind of tokenizer a file holds (bytes: byte-level BPE; json: another of that library; model: sentencepiece), and its content."""
    with open(path, "rb") as f:  # on the driver, which sends it to the workers
        raw = f.read()
    if path.endswith(".model"):
        return "model", raw
    told = json.loads(raw)
    pre = told.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
    return ("bytes" if plain else "json"), raw


def runs_of(name: str) -> list[tuple[int, int]]:
    """The code points of a class, as the library has it: first and last of each run."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return [(ord(s[0]), ord(s[-1])) for s, _ in Split(Regex(f"[^{name}]+"), "removed").pre_tokenize_str(every)]


@functools.cache
def cuts() -> tuple[str, str]:
    """A pattern with explicit classes, and all characters that the regex module puts in other classes than the library."""
    known, other = {}, set()
    for name, escape in CLASSES.items():
        runs = runs_of(escape)
        known[name] = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)
        ours = regex.compile(escape)
        theirs = {c for a, b in runs for c in range(a, b + 1)}
        other |= theirs ^ {c for c in range(0x110000) if ours.match(chr(c))}
    explicit = {k: f"[{v}]" for k, v in known.items()} | {"O": "[^" + "".join(known.values()) + "]", "T": f"[^{known['S']}]"}
    return PATTERN.format(**explicit), "".join(chr(c) for c in sorted(other) if not 0xD800 <= c < 0xE000)


class Lengths(dict):
    """Numbers of tokens of pre-tokens: the first tier's, and a bounded cache of what the library was asked."""

    def __init__(self, ask: Callable[[str], int], frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.ask, self.frequent = ask, frequent

    def __missing__(self, pre: str) -> int:
        n = self.ask(pre)
        if len(pre) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n


def packed(table: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """A first tier as three arrays: the pre-tokens' bytes, where each ends, their numbers."""
    raw = [k.encode() for k in table]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int32).tobytes(), np.array(list(table.values()), np.uint16).tobytes()


def unpacked(tier: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    body, ends, n = tier[0], np.frombuffer(tier[1], np.int32).tolist(), np.frombuffer(tier[2], np.uint16).tolist()
    return {body[a:b].decode(): k for a, b, k in zip([0, *ends], ends, n)}


class TokenCounter:
    """Counts the tokens of texts; made once in each worker task."""

    def __init__(self, kind: str, raw: bytes, pattern: str, other: str, tier: tuple | None = None) -> None:
        self.kind = kind
        if kind == "model":
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
            return
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        added = json.loads(raw).get("added_tokens") or []
        #: Special strings are cut out by hand only where nothing about them depends on what stands beside them.
        self.awkward = [a["content"] for a in added if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]]
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = regex.compile(PATTERN.format(**CLASSES, O=r"[^\s\p{L}\p{N}]", T=r"\S")).findall
        self.pattern, self.other, self.exact = pattern, frozenset(other), None
        self.lengths = Lengths(self.ask, unpacked(tier) if tier else {})

    def ask(self, pre: str) -> int:
        if self.kind == "bytes":
            return len(self.library.encode(pre, add_special_tokens=False))
        return len(self.library.model.tokenize(pre))

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.kind == "bytes":
            if self.other.isdisjoint(text):
                return self.fast(text)
            self.exact = self.exact or re.compile(self.pattern).findall
            return self.exact(text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.library.pre_tokenizer is not None else [text] * bool(text)

    def parts(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens and its number of special strings."""
        if self.special is None or not self.special.search(text):
            return self.cut(text), 0
        pieces = self.special.split(text)
        return [p for piece in pieces for p in self.cut(piece)], len(pieces) - 1

    def count(self, text: str) -> int:
        if self.kind == "model":
            return len(self.whole.encode(text, num_threads=1))
        if any(a in text for a in self.awkward):
            return len(self.library.encode(text, add_special_tokens=False))
        pre, special = self.parts(text)
        return special + sum(map(self.lengths.__getitem__, pre))


def first_tier(docs: DataFrame, kind: str, raw: bytes, pattern: str, other: str) -> tuple:
    """The packed table of the pre-tokens that are most frequent in about SAMPLE_DOCS documents. The sample is written, then counted in a few tasks, each
    of which gives its FREQUENT most frequent ones to the driver."""
    n = docs.count()
    sample = materialise(docs.select("text").filter("text is not null").sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=12), "token-sample")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = TokenCounter(kind, raw, pattern, other), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(p for p in cutter.parts(t)[0] if len(p) <= LONGEST)
                if len(seen) > 8 * FREQUENT:
                    seen = Counter(dict(seen.most_common(4 * FREQUENT)))
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64()), pa.array([cutter.ask(p) for p, _ in top], pa.int64())], ["pre", "n", "tokens"])

    total, tokens = Counter(), {}
    for r in sample.coalesce(8).mapInArrow(run, "pre string, n long, tokens long").toArrow().to_pylist():  # at most 8 tables of FREQUENT rows
        total[r["pre"]] += r["n"]
        tokens[r["pre"]] = r["tokens"]
    return packed({p: tokens[p] for p, _ in total.most_common(FREQUENT) if tokens[p] < 1 << 16})


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens without special tokens put before or behind, over_limit (n_tokens > limit) of every whole text."""
    kind, raw = load(path or model_file())
    pattern, other = cuts() if kind == "bytes" else ("", "")
    tier = first_tier(docs, kind, raw, pattern, other) if kind != "model" else None
    held = docs.sparkSession.sparkContext.broadcast({"args": (kind, raw, pattern, other, tier)})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*held.value["args"])
        for batch in batches:
            n = pa.array([counter.count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    key = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
