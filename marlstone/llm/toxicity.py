"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic (1) and of ordinary (0) texts. A class's counts are first discounted towards the counts that
both classes share: an expression's count n is divided between the classes as the model one order lower divides it (a
bigram as its word, a word as the classes' sizes), and only what a class has beyond that by more than ERRORS standard
errors is its own. So an expression that is too rare to tell the classes apart has shared counts only, and the two models
agree on it up to their lower orders. With these counts both are interpolated Kneser-Ney models:

    P_c(w | v) = kept_c(v, w) / s_c(v) + l_c(v) P_c(w)      P_c(w) = kept_c(w) / s_c + g_c C(w)

where kept is a count less its discount (DISCOUNT, divided between the classes like the count), s the sum of counts, l and
g the mass that discounts leave, so that all sum to one, and C(w) the share of w in the different bigrams of both classes
(continuation counts). Expressions count once a document, and of equal texts only one is counted.

The score is the difference of the log-likelihoods per word, turned into a probability by a logistic curve that is fitted
on a fold of the labelled rows that the counts have not seen. What a word adds to a difference is written as a sum: the
value of the word, that of the word before it (l_1 / l_0), and that of the bigram (what it changes in these). A bigram that
tells no more than its word takes its word's and its context's values; words that tell nothing have one ratio, which is a
constant per word and left to the curve. So only keys that tell the classes apart have a value.

All texts' words and bigrams are counted exactly, under keys of 64 bits: tasks send sorted partial counts to buckets of
words, each of which holds all contexts of its words. The tables grow with the corpus. Of the values, the HEAD of the most
frequent keys are sent to all tasks; n-grams that may be among the others (a filter of BITS bits tells which cannot be)
are joined to the table. Values are whole multiples of 1 / UNIT, so sums are exact.

Defined cases: null and empty texts have no words; they and texts of unseen words get the score of a difference of 0;
null labels are left out; a doc_id with several labels counts as toxic if one of them is; rows that repeat a doc_id each
have their own score and are learned from by their own texts; a row without doc_id is scored, and is not held out; with
one class missing, every score is that class's share; an empty table gives an empty result; only text, doc_id and the
labels are read, other columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, U, byte_hash, discard, joined, materialise, mix, release, slices, tidy, word_spans

FOLDS = 5
#: Of the folds, this one is never learned from; the counts leave out CALIBRATION too, on which the curve is fitted.
HELD_OUT, CALIBRATION = 0, 4
#: Keys that are sent to all tasks, bits of the filters, and the unit of values.
HEAD, BITS, UNIT = 1 << 18, 1 << 25, 1 << 32
#: The absolute discount, and the standard errors by which a class's count must differ from the shared one.
DISCOUNT, ERRORS = 0.75, 3.0
#: Rows that the curve is fitted on, at most (a bounded sample of the calibration fold, the smallest hashes of doc_id).
CURVE_ROWS = 50_000
#: Expressions that a task counts together, and bytes of text for a bucket, about.
TOGETHER, BUCKET_BYTES = 1 << 21, 8 << 20

#: Words are runs of letters, digits and bytes above 127.
SEPARATOR = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
START, CONTEXT_SALT = U(0x2545F4914F6CDD1D), 0x5DEECE66D
BIGRAM_KEY = "key ^ (shiftleft(before, 21) | shiftrightunsigned(before, 43))"


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: word, the word before (or START), key of the bigram; and where texts begin."""
    data, at = joined(texts)
    data = FOLD[data]
    start, end = word_spans(data, SEPARATOR)
    h, first = byte_hash(data, start, end), np.searchsorted(start, at)
    before = np.concatenate([[START], h[:-1]]) if len(h) else h
    before[first[:-1][first[:-1] < first[1:]]] = START
    return h, before, h ^ (before << U(21) | before >> U(43)), first


def _once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the first of equal keys of a document."""
    return np.unique(mix(doc ^ key), return_index=True)[1]


def _summed(order: np.ndarray, new: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n[order], np.flatnonzero(new), axis=0) if len(order) else n[:0]


def _reduced(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different keys, sorted by the first, then the next, and the sums of n (two columns)."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return tuple(k[new] for k in keys), _summed(order, new, n)


def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words the classes' documents have, each once a document."""
    n = [0, 0]
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
        for a, b in slices(texts, 1 << 20):
            word, _, _, first = tokens(texts[a:b])
            doc = np.repeat(np.arange(b - a), np.diff(first))
            once = _once(mix(doc.astype(np.uint64)), word)
            for c, k in enumerate(np.bincount(toxic[a:b][doc[once]], minlength=2)):
                n[c] += int(k)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], ["n0", "n1"])
    release()


PACKED = "bucket int, words binary, word_counts binary, befores binary, counts binary"


def _packed(parts: list, buckets: int) -> Iterator[pa.RecordBatch]:
    (word,), wn = _reduced((np.concatenate([p[0] for p in parts]),), np.concatenate([p[1] for p in parts]))
    (of, before), n = _reduced((np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])), np.concatenate([p[4] for p in parts]))
    own = np.searchsorted(of, word, "right") - np.searchsorted(of, word, "left")  # a word's bigrams follow one another
    bucket = lambda k: ((k >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # noqa: E731  in order of the words
    ends, pair_ends = (np.searchsorted(bucket(k), np.arange(buckets + 1)) for k in (word, of))
    rows = []
    for b in range(buckets):
        a, e, p, q = ends[b], ends[b + 1], pair_ends[b], pair_ends[b + 1]
        if e > a:
            rows.append((b, word[a:e].tobytes(), zlib.compress(np.concatenate([wn[a:e, 0], wn[a:e, 1], own[a:e]]).astype(np.uint32).tobytes(), 1), before[p:q].tobytes(), zlib.compress(n[p:q].T.astype(np.uint32).tobytes(), 1)))
    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["bucket", "words", "word_counts", "befores", "counts"])


def count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed partial counts of (text, toxic) rows."""
    parts, held = [], 0
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
        for a, b in slices(texts, 1 << 20):
            word, before, pair, first = tokens(texts[a:b])
            doc = np.repeat(np.arange(b - a), np.diff(first))
            salt, is_toxic = mix(doc.astype(np.uint64)), toxic[a:b][doc]
            both = np.stack([1 - is_toxic, is_toxic], 1).astype(np.int64)
            w, p = _once(salt, word), _once(salt, pair)
            (words,), wn = _reduced((word[w],), both[w])
            (of, befores), n = _reduced((word[p], before[p]), both[p])
            parts.append((words, wn, of, befores, n))
            held += len(words) + len(of)
            if held >= TOGETHER:
                yield from _packed(parts, buckets)
                parts, held = [], 0
    if held:
        yield from _packed(parts, buckets)
    release()


def divided(n: np.ndarray, n1: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The toxic class's part of counts n: as `share` has it, and what it has beyond that by more than ERRORS standard errors."""
    shared = n * share
    beyond = n1 - shared
    return shared + np.sign(beyond) * np.maximum(np.abs(beyond) - ERRORS * np.sqrt(n * share * (1 - share) + 1), 0)


WORD, PAIR, CONTEXT, TOTAL = 0, 1, 2, 3
#: of a WORD: n, toxic part, contexts; of a PAIR besides its n1, n2 (of the pair); of a CONTEXT: n, followers, and by how much its toxic sums differ from what the classes' sizes give; of TOTAL: sums.
MERGED = "kind int, before long, key long, n double, part double, contexts double, pair_n double, pair_part double"


@tidy
def merged(rows: pa.Table, share: float) -> pa.Table:
    """All counts of a bucket of words: WORDs and PAIRs that tell the classes apart, all CONTEXTs (partial sums), and a TOTAL."""
    words, wn, of, befores, n = [], [], [], [], []
    for w, wc, b, c in zip(*(rows[x].to_pylist() for x in ("words", "word_counts", "befores", "counts"))):
        w, wc = np.frombuffer(w, np.uint64), np.frombuffer(zlib.decompress(wc), np.uint32).reshape(3, -1).astype(np.int64)
        words.append(w)
        wn.append(wc[:2].T)
        of.append(np.repeat(w, wc[2]))
        befores.append(np.frombuffer(b, np.uint64))
        n.append(np.frombuffer(zlib.decompress(c), np.uint32).reshape(2, -1).T.astype(np.int64))
    (word,), wn = _reduced((np.concatenate(words),), np.concatenate(wn))
    (of, before), n = _reduced((np.concatenate(of), np.concatenate(befores)), np.concatenate(n))
    w_all = wn.sum(1).astype(float)
    w_part = divided(w_all, wn[:, 1], np.full(len(word), share))
    at = np.searchsorted(word, of)
    contexts = np.bincount(at, minlength=len(word)).astype(float)
    w_share = w_part / w_all
    p_all = n.sum(1).astype(float)
    p_part = divided(p_all, n[:, 1], w_share[at])
    tells, p_tells = w_part != w_all * share, p_part != p_all * w_share[at]
    kept = 1 - DISCOUNT / p_all
    order = np.argsort(before, kind="stable")
    v = before[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    sums = _summed(order, new, np.stack([p_all, np.ones_like(p_all), p_part - share * p_all, (p_part - share * p_all) * kept], 1))
    sums[np.abs(sums) < 1e-9] = 0
    k = np.flatnonzero(p_tells)
    zero = lambda m: np.zeros(m)
    w_kept = (1 - DISCOUNT / w_all)
    total = [np.array([float(x)]) for x in (w_all.sum(), w_part.sum(), len(of), (w_all * w_kept).sum(), (w_part * w_kept).sum())]
    t = np.flatnonzero(tells)
    m = [len(t), len(k), int(new.sum()), 1]
    return pa.table({
        "kind": np.repeat(np.array([WORD, PAIR, CONTEXT, TOTAL], np.int32), m),
        "before": np.concatenate([np.zeros(m[0], np.int64), before[k].view(np.int64), v[new].view(np.int64), [0]]),
        "key": np.concatenate([word[t].view(np.int64), of[k].view(np.int64), np.zeros(m[2] + 1, np.int64)]),
        "n": np.concatenate([w_all[t], w_all[at[k]], sums[:, 0], total[0]]),
        "part": np.concatenate([w_part[t], w_part[at[k]], sums[:, 1], total[1]]),
        "contexts": np.concatenate([contexts[t], contexts[at[k]], sums[:, 2], total[2]]),
        "pair_n": np.concatenate([zero(m[0]), p_all[k], sums[:, 3], total[3]]),
        "pair_part": np.concatenate([zero(m[0]), p_part[k], zero(m[2]), total[4]]),
    })


def sizes(texts: DataFrame) -> tuple[int, int]:
    """Words of the classes' texts, each once a document."""
    n = texts.mapInArrow(events, "n0 long, n1 long").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    return n["n0"] or 0, n["n1"] or 0


def counted(texts: DataFrame, share: float, buckets: int) -> DataFrame:
    return texts.mapInArrow(lambda it: count(it, buckets), PACKED).groupBy("bucket").applyInArrow(lambda t: merged(t, share), MERGED)


def values(counts: DataFrame, share: float) -> DataFrame:
    """k, v, n: what each word, context and bigram that tells the classes apart adds, in UNITs, and its documents."""
    total = counts.filter(f"kind = {TOTAL}").agg(*[F.sum(c).alias(c) for c in ("n", "part", "contexts", "pair_n", "pair_part")]).first()
    size = [(total["n"] or 0.0) - (total["part"] or 0.0), total["part"] or 0.0]
    if min(size) <= 0:
        return counts.selectExpr("key as k", "0L as v", "0L as n").limit(0)
    left = [1 - (total["pair_n"] - total["pair_part"]) / size[0], 1 - total["pair_part"] / size[1]]
    part = lambda c, n="n", p="part": p if c else f"({n} - {p})"
    p = lambda c: f"({part(c)} * (1 - {DISCOUNT!r}D / n) / {size[c]!r}D + {left[c]!r}D * contexts / {total['contexts']!r}D)"
    same = float(np.log((share / size[1]) / ((1 - share) / size[0])))  # the ratio of words that tell nothing
    ratio = f"(ln({p(1)} / {p(0)}) - {same!r}D)"
    # a context's sums: of class 1 by the classes' sizes, and what bigrams add; of class 0 the rest
    context = counts.filter(f"kind = {CONTEXT}").groupBy("before").agg(F.sum("n").alias("vn"), F.sum("part").alias("follow"), F.sum("contexts").alias("more"), F.sum("pair_n").alias("more_kept")).filter("abs(more) > 1e-6 or abs(more_kept) > 1e-6")
    s = lambda c: f"({share!r}D * vn + more)" if c else f"({1 - share!r}D * vn - more)"
    kept = lambda c: f"({share!r}D * (vn - {DISCOUNT!r}D * follow) + more_kept)" if c else f"({1 - share!r}D * (vn - {DISCOUNT!r}D * follow) - more_kept)"
    context = context.selectExpr("before", "vn", *[f"greatest({s(c)}, 1e-9D) as s{c}" for c in (0, 1)], *[f"least(1D, greatest(1e-6D, 1 - {kept(c)} / greatest({s(c)}, 1e-9D))) as l{c}" for c in (0, 1)])
    context = materialise(context, "toxicity-context")
    pairs = counts.filter(f"kind = {PAIR}").join(context, "before")
    both = lambda c: f"({part(c, 'pair_n', 'pair_part')} * (1 - {DISCOUNT!r}D / pair_n) / s{c} + l{c} * {p(c)})"
    fixed = lambda x: f"cast(round(({x}) * {UNIT}D) as long) as v"
    every = (
        pairs.selectExpr(f"{BIGRAM_KEY} as k", fixed(f"ln({both(1)} / {both(0)}) - {same!r}D - ln(l1 / l0) - case when part <> n * {share!r}D then {ratio} else 0D end"), "cast(pair_n as long) as n")
        .unionByName(counts.filter(f"kind = {WORD}").selectExpr("key as k", fixed(ratio), "cast(n as long) as n"))
        .unionByName(context.selectExpr(f"before ^ {CONTEXT_SALT}L as k", fixed("ln(l1 / l0)"), "cast(vn as long) as n"))
    )
    return every.filter("v <> 0")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method with a little ridge."""
    if len(y) == 0 or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return 0.0, float(np.log(share / (1 - share)))
    scale = max(float(x.std()), 1e-9)
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fold(column: str = "doc_id"):
    return F.expr(f"crc32(cast(cast({column} as string) as binary)) % {FOLDS}")


def fold(column: str = "doc_id"):
    return F.expr(f"crc32(cast(cast({column} as string) as binary)) % {FOLDS}")


def differences(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, x: the difference of the log-likelihoods per word, of every row."""
    head = table.orderBy(F.desc("n"), "k").limit(HEAD).toPandas()  # HEAD rows at most
    more = len(head) == HEAD
    bits = np.zeros(BITS // 64, np.uint64)
    if more:
        n, k = int(head["n"].iloc[-1]), int(head["k"].iloc[-1])
        rest = materialise(table.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("k") > k))).select("k", "v"), "toxicity-rest")
        held = rest.groupBy(F.expr(f"shiftright(k & {BITS - 1}L, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(k & 63L as int)))").alias("bits")).toPandas()  # BITS / 64 rows at most
        bits[held["at"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    head = head.sort_values("k")
    model = docs.sparkSession.sparkContext.broadcast((head["k"].to_numpy(np.int64), head["v"].to_numpy(np.int64), bits))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, vs, bits = model.value
        rng = np.random.default_rng()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts, 1 << 20):
                word, before, pair, first = tokens(texts[a:b])
                total, left = np.zeros(len(word), np.int64), [np.zeros((2, 0), np.int64)]
                doc = np.repeat(np.arange(b - a), np.diff(first))
                for k in (word, before ^ U(CONTEXT_SALT), pair):
                    k = k.view(np.int64)
                    at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
                    hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
                    total[hit] += vs[at[hit]]
                    if more:
                        place = k & (BITS - 1)
                        may = ~hit & ((bits[place >> 6] >> (place & 63).astype(np.uint64)) & U(1)).astype(bool)
                        left.append(np.stack([doc[may], k[may]]))
                sums = np.concatenate([[0], np.cumsum(total)])
                found = np.concatenate(left, 1)
                found = found[:, np.argsort(found[0], kind="stable")]
                ends = np.searchsorted(found[0], np.arange(1, b - a))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "row": rng.integers(0, (1 << 63) - 1, b - a), "known": sums[first[1:]] - sums[first[:-1]], "n": np.diff(first), "keys": np.split(found[1], ends)})
        release()

    rows = docs.select("doc_id", "text").mapInPandas(known, "doc_id long, row long, known long, n long, keys array<long>")
    if not more:
        return rows.selectExpr("doc_id", f"known / {UNIT}D / greatest(n, 1) as x")
    rows = materialise(rows, "toxicity-known")
    added = rows.select("row", F.explode("keys").alias("k")).groupBy("row", "k").agg(F.count("*").alias("c")).join(rest, "k").groupBy("row").agg(F.expr("sum(c * v)").alias("added"))
    return rows.join(added, "row", "left").selectExpr("doc_id", f"(known + coalesce(added, 0L)) / {UNIT}D / greatest(n, 1) as x")


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among keys: what comes before a join, so that it shuffles few others. A filter of BITS bits tells which can't be (at 100 keys a bit it lets all pass)."""
    place = F.expr(f"xxhash64({key}) & {BITS - 1}L")
    bits = keys.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63L as int)))").alias("bits"))
    placed = rows.withColumn("p", place).withColumn("at", F.expr("shiftright(p, 6)"))
    return placed.join(F.broadcast(bits), "at").filter("shiftright(bits, cast(p & 63L as int)) & 1L = 1L").drop("p", "at", "bits")  # BITS / 64 rows at most


def learned_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, toxic of the labelled rows of the learned folds, of equal texts one."""
    learned = f"fold not in ({HELD_OUT}, {CALIBRATION})"
    own = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    single = own.select("doc_id", "digest").join(known.filter(learned), "doc_id").groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"))
    single = materialise(single, "toxicity-single")
    may = sifted(own.withColumn("fold", fold()).filter(learned), "doc_id", single)
    out = materialise(may.select("doc_id", "digest", "text").join(single.hint("merge"), ["doc_id", "digest"]).select("text", "toxic"), "toxicity-text")
    discard(single)
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("cast(toxic > 0 as int)")).alias("toxic")).withColumn("fold", fold()).filter(f"fold <> {HELD_OUT}")
    texts = learned_texts(docs, known)
    n0, n1 = sizes(texts)
    share = n1 / (n0 + n1) if n0 and n1 else 0.5
    buckets = max(1, -(-texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"] // BUCKET_BYTES))
    counts = materialise(counted(texts, share, buckets), "toxicity-count")
    discard(texts)
    table = materialise(values(counts, share) if n0 and n1 else values(counts, share).limit(0), "toxicity-value")
    discard(counts)
    scored = materialise(differences(docs, table), "toxicity-x")
    sample = scored.join(known.filter(f"fold = {CALIBRATION}"), "doc_id").select("x", "toxic").orderBy(F.xxhash64("doc_id")).limit(CURVE_ROWS).toPandas()
    a, b = curve(sample["x"].to_numpy(float), sample["toxic"].to_numpy(float))
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, F.expr(f"1D / (1D + exp(-greatest(-700D, least(700D, {a!r}D * x + {b!r}D))))").alias("score")).withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))


def fold_of(doc_id: int) -> int:
    return crc32(str(doc_id).encode()) % FOLDS
