"""Each operator on a small awkward table, against a brute-force version where SQL has none."""

import collections
import hashlib
import itertools
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, components, mixing, ngram_join, pieces, quality_rules, repeats, sharding, suffix_sort, surrogates, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(300)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY, n))


BASE = text(200)
NEAR = BASE.replace(BASE.split()[50], "other", 1)
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, NEAR, None), (4, None, "b"), (5, "", "b"), (6, "one two", "b"), (7, "one two", "c"), (8, "é " * 400, "c"), (9, BASE[:700] + text(150), "c"), (10, " \t\n ", None),
    (11, "x" * 30_000, "a"), (12, text(3000), "a"), (13, BASE + " tail", "b"), (14, BASE.upper(), "b"), (15, BASE[10:600] * 3, "c"), (16, "mail a.b@example.com and a.b@example.com", "c"),
]
ROWS += [(100 + i, text(int(RNG.integers(1, 80))), ["a", "b", "c", None][i % 4]) for i in range(60)]
SCHEMA = "doc_id long, text string, source string, rn int, tokens string, lang string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, 1, "clash", "en", None if t is None else len(t)) for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def links_brute(width, percent):
    sets = {}
    for i, t, _ in ROWS:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, width, percent):
    assert rows_of(ngram_join.join(docs, width, percent), "n_shingles", "component_id") == links_brute(width, percent)


def test_ngram_join_of_repeated_ids(spark):
    """Two texts under one doc_id lose no link, and rows without one are joined too."""
    a, b = text(120), text(120)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, a), (10, b), (None, b), (None, "all alone here " + text(9)), (11, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row_at int, component string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.join(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5), (10, 5), (11, 11)]
    import corpus_pipeline as c

    kept = c.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept if r["text"]) == sorted([(5, a), (5, b), (-1, rows[7][1])]) and len(kept) == 4
    assert c.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_ngram_join_hashes_each_text_once(spark, monkeypatch):
    """Of rows with one text one is hashed and counted, whatever their number; all of them get its component."""
    a, b, c = (" ".join(BASE.split()[i : i + 66]) for i in (0, 67, 134))
    some = [a, a + " more", b, " ", None, "short one"]
    docs = spark.createDataFrame([(10 * k + i, t) for k in range(4) for i, t in enumerate(some)] + [(99, c)], "doc_id long, text string")
    sizes, write = {}, ngram_join.materialise

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == {10 * k + i: c if c is not None else 10 * k + i for k in range(4) for i, c in enumerate([0, 0, 2, None, None, 5])} | {99: 99}
    assert sizes["ngram-members"] == 7
    gone = ngram_join.repeated(docs, 3, 90)
    assert gone.count() == 13


def test_ngram_join_tiles(docs, monkeypatch):
    """A cluster larger than a tile loses no link."""
    monkeypatch.setattr(ngram_join, "TILE", 2)
    assert rows_of(ngram_join.join(docs, 3, 90), "n_shingles", "component_id") == links_brute(3, 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_quality_rules(docs, empty):
    got = rows_of(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t, _ in ROWS:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = len(covered)
        assert got[i] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)), i
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in rows_of(quality_rules.judge(docs), "kept").items() if v[0]}


def test_a_host_is_rejected(spark):
    """Twenty hosts of ten documents; ten hosts have none with too many symbols, nine have three, the last has nine or ten. By hand:

    ten of ten: f = 37, m = 37/200 = 0.185, q = (9 * 9 + 100) / 10 = 18.1, spread = 0.0905 - 0.034225 - 0.150775 * 20/200 = 0.0411975,
      w = 0.150775 / 0.0411975 - 1 = 2.6598, rate = (10 + 0.185 * 2.6598) / 12.6598 = 0.8288: above 0.8, the host goes;
    nine of ten: m = 0.18, q = 16.2, spread = 0.081 - 0.0324 - 0.01476 = 0.03384, w = 3.3617, rate = (9 + 0.18 * 3.3617) / 13.3617 = 0.7189: it stays, though 0.9 of it fails.
    """
    import duckdb

    fail, fine = " ".join(f"{i}w#{i}" for i in range(30)), " ".join(f"{i}word{i}" for i in range(30))
    for bad in (9, 10):
        failures = [0] * 10 + [3] * 9 + [bad]
        rows = [(10 * h + i, fail if i < n else fine, f"h{h}") for h, n in enumerate(failures) for i in range(10)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        judged = quality_rules.judge(docs).collect()
        assert not any(r["base_failed"] for r in judged) and {r["host_symbols"] for r in judged if r["doc_id"] >= 190} == {bad}
        gone = {r["doc_id"] for r in judged if not r["kept"]}
        assert gone == (set(range(190, 200)) if bad == 10 else set())
        assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == set(range(200)) - gone
        con = duckdb.connect()
        con.register("documents", docs.toPandas())
        assert {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE NOT kept").fetchall()} == gone


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = text(40).split()
        if toxic:
            for k in range(0, 40, 8):
                words[k] = ["vile", "scum"][k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (toxicity.fold_of(r["doc_id"]) == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs.limit(3), none).collect()} == {0.5}
    assert toxicity.score(empty, none).count() == 0


def kneser_ney(rows, start="^"):
    """P_c(w | v) by the book, from (text, toxic) rows: plain dictionaries instead of hashed tables. Also what the parts sum to."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\uffff]+", t.lower())
    pair, word = collections.Counter(), collections.Counter()
    for t, c in rows:
        w = split(t)
        pair.update((x, c) for x in set(zip([start, *w], w)))
        word.update((x, c) for x in set(w))
    share = sum(n for (_, c), n in word.items() if c) / sum(word.values())

    def part(n0, n1, share):
        n, e = n0 + n1, (n0 + n1) * share
        d = n1 - e
        return e + np.sign(d) * max(abs(d) - toxicity.ERRORS * np.sqrt(n * share * (1 - share) + 1), 0)

    d = toxicity.DISCOUNT
    w_part = {x: part(word[x, 0], word[x, 1], share) for x in {x for x, _ in word}}
    n_of = {x: word[x, 0] + word[x, 1] for x in w_part}
    share_of = {x: w_part[x] / n_of[x] for x in w_part}
    pairs = {x: (pair[x, 0] + pair[x, 1], part(pair[x, 0], pair[x, 1], share_of[x[1]])) for x in {x for x, _ in pair}}
    of_class = lambda n, p, c: p if c else n - p
    contexts = collections.Counter(w for _, w in pairs)
    size = [sum(of_class(n_of[x], w_part[x], c) for x in n_of) for c in (0, 1)]
    left = [1 - sum(of_class(n_of[x], w_part[x], c) * (1 - d / n_of[x]) for x in n_of) / size[c] for c in (0, 1)]

    def p_word(w, c):
        return of_class(n_of[w], w_part[w], c) * (1 - d / n_of[w]) / size[c] + left[c] * contexts[w] / len(pairs)

    def p_pair(w, v, c):
        under = {x: n for x, n in pairs.items() if x[0] == v}
        s = sum(of_class(*n, c) for n in under.values())
        kept = lambda n: of_class(*n, c) * (1 - d / n[0])
        back = 1 - sum(map(kept, under.values())) / s
        return (kept(pairs[v, w]) / s if (v, w) in pairs else 0) + back * p_word(w, c)

    return p_word, p_pair, n_of, pairs, w_part, share, size


def test_toxicity_is_kneser_ney(spark):
    """The models sum to one, and the table's values are their differences of logarithms."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(["vile" if c and rng.random() < 0.7 else "kind", "is", *rng.choice(["a", "b", "c", "d"], 4), *(["so", "very"] if c else ["very", "so"])]), c) for c in [0, 0, 0, 1] * 60]
    rows = list(dict.fromkeys(rows))
    p_word, p_pair, n_of, pairs, w_part, share, size = kneser_ney(rows)
    for c in (0, 1):
        assert abs(sum(p_word(w, c) for w in n_of) - 1) < 1e-9
        assert abs(sum(p_pair(w, "is", c) for w in n_of) - 1) < 1e-9 and abs(sum(p_pair(w, "so", c) for w in n_of) - 1) < 1e-9
    texts = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    n = toxicity.sizes(texts)
    assert n[1] / (n[0] + n[1]) == share
    counts = toxicity.counted(texts, share, 3)
    table = {r["k"]: r["v"] / toxicity.UNIT for r in toxicity.values(counts, share).collect()}
    same = np.log((share / size[1]) / ((1 - share) / size[0]))

    def found(v, w):
        word, before, pair, _ = toxicity.tokens([f"{v} {w}"])
        keys = [word[1], before[1] ^ np.uint64(toxicity.CONTEXT_SALT), pair[1]]
        return sum(table.get(int(k.view(np.int64)), 0.0) for k in keys)

    told = 0
    for v, w in pairs:
        telling = w_part[w] != n_of[w] * share
        if v != "^" and pairs[v, w][1] != pairs[v, w][0] * (w_part[w] / n_of[w]):
            told += 1
            assert abs(found(v, w) + same - np.log(p_pair(w, v, 1) / p_pair(w, v, 0))) < 1e-6
        elif telling and v not in {x for x, _ in pairs}:
            assert abs(found(v, w) + same - np.log(p_word(w, 1) / p_word(w, 0))) < 1e-6
    assert told >= 2
    word = toxicity.tokens(["vile"])[0][0].view(np.int64)
    assert abs(table[int(word)] + same - np.log(p_word("vile", 1) / p_word("vile", 0))) < 1e-6


def test_toxicity_counts_grow(spark, monkeypatch):
    """Contexts are counted to the last one, and values beyond those sent to all tasks are joined; odd rows have scores."""
    rows = [(" ".join(f"w{k} hub" for k in range(1000)), 0), ("hub vile", 1), ("w1 hub", 1)]
    counts = toxicity.counted(spark.createDataFrame(rows, "text string, toxic int"), 0.2, 1)
    assert counts.filter(f"kind = {toxicity.TOTAL}").first()["contexts"] == 2003
    texts = [(i, ("vile scum " if i % 4 == 0 else "kind folk ") * 3 + text(20)) for i in range(200)] + [(None, "scum"), (None, "vile"), (3, "folk"), (3, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in texts], "doc_id long, text string, toxic int, at string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    order = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["held_out"]) for r in rs)
    want = order(toxicity.score(docs, labels).collect())
    monkeypatch.setattr(toxicity, "HEAD", 2)
    assert len(want) == 204 and order(toxicity.score(docs, labels).collect()) == want


def test_repeats(docs, empty):
    seen, want = set(), {}
    for i, t, _ in sorted(ROWS, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest())
    assert rows_of(repeats.digest(repeats.remove(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.remove(empty).count() == 0


def test_suffix_array():
    for n in range(1, 60):
        s = np.concatenate([RNG.integers(0, 3, n), [0]]).astype(np.uint8)
        b = bytes(s)
        sa = suffix_sort.suffix_array(s)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        common = suffix_sort.common_prefixes(s, sa)
        for r in range(1, len(b)):
            x, y, h = sa[r - 1], sa[r], 0
            while x + h < len(b) and y + h < len(b) and b[x + h] == b[y + h] != 0:
                h += 1
            assert common[r] == h


def test_suffix_array_of_many_letters():
    """Alphabets beyond a byte are induced entry by entry, and texts whose reduced text is one are sorted by recursion."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 400):
        for letters in (2, 5, 40):
            s = rng.integers(0, letters, n) * 100
            s[n // 2 :] = s[: n - n // 2]
            assert suffix_sort.suffix_array(s.astype(np.int32)).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    raw = rng.integers(97, 123, 20_000).astype(np.uint8)
    raw[10_000:15_000] = raw[:5_000]
    whole = raw.tobytes()
    assert suffix_sort.suffix_array(raw).tolist() == sorted(range(len(raw)), key=lambda i: whole[i:])


def test_nearest(spark):
    x = RNG.normal(size=(600, 24))
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(1000, None), (1100, [0.0] * 24), (1200, [float("nan")] * 24), (1300, [1.0, None]), (1400, [])]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert set(got) == set(range(0, 600, 100)) and hit >= 54
    assert [i for i, _ in got[0]] == list(range(50, 60))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_of_vectors_of_all_lengths(spark):
    """Lengths spread over orders of magnitude: a hash sees directions only, but the nearest are often short vectors of any direction."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)) * np.exp(rng.normal(size=(3000, 1)))
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    best = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11].tolist()) - {q} for q in range(0, 3000, 100)}
    assert sum(len(got[q] & b) for q, b in best.items()) >= 0.9 * sum(map(len, best.values()))


def test_nearest_of_repeated_ids(spark):
    """A row that repeats the query's id with another vector is a candidate; clashing names don't matter."""
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.1], 2), (100, [1.0, 0.0], 3), (1, [1.0, 0.0], 4), (2, [0.0, 1.0], 5)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id int")).collect())
    near, far, off = 0.1, round(2**0.5, 6), round((1 + 0.81) ** 0.5, 6)
    assert got == sorted([(100, 1, 1, 0.0), (100, 2, 100, near), (100, 3, 2, far), (100, 1, 1, near), (100, 2, 100, near), (100, 3, 2, off)])


@pytest.mark.parametrize("bucket", [2, 0.1])
def test_nearest_with_more_axes(spark, monkeypatch, bucket):
    """Hashes of joined axes lose no neighbours: bucket sizes that asked for two and for three axes of 16 probes each."""
    monkeypatch.setattr(ann, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 24))
    few = rng.normal(size=(7, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(few)]
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    best = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist()) for q in range(0, 500, 100)}
    assert sum(len(got[q] & b) for q, b in best.items()) >= 9 * len(best)
    assert got[10_000] == set(range(10_001, 10_007))


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    by_text, load, slot = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    texts = {i: t for i, t, _ in ROWS}
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
        slot[r["shard"]].append(r["slot"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["law"] == "bytes"
    biggest = max(sum(r["size"] for r in got if texts[r["doc_id"]] == t) for t in set(texts.values()))
    assert max(load.values()) <= max(biggest, sum(load.values()) / 16 * 1.05)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slot.values())
    assert sharding.shard(empty).count() == 0


def test_sharding_by_levels(spark, monkeypatch):
    """Many buckets are differenced level by level; loads stay near equal, and odd rows keep slots of their own."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 8)
    monkeypatch.setattr(sharding, "FAN", 3)
    rows = [(i % 700 if i % 5 else None, "w" * (1 + i * 37 % 500) + str(i % 900)) for i in range(1000)]
    got = sharding.shard(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, total int")).collect()
    load, slot = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slot[r["shard"]].append(r["slot"])
    assert len(got) == 1000 and sum(load.values()) == sum(len(t) + 1 for _, t in rows)
    assert max(load.values()) - min(load.values()) <= sum(load.values()) / 16 / 100
    assert all(sorted(s) == list(range(len(s))) for s in slot.values())


def test_differencing_is_tight():
    sizes = RNG.integers(1, 1000, 500).tolist()
    parts = sharding.difference([([s] + [0] * 15, [i] + [None] * 15) for i, s in enumerate(sizes)])
    held = [sorted(sharding.flatten(p)) for p in parts]
    assert sorted(x for h in held for x in h) == list(range(500))
    sums = [sum(sizes[i] for i in h) for h in held]
    assert max(sums) - min(sums) <= 2


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[(r["source_size"], r["target"])].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for (_, target), rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows) / 2  # documents are drawn whole
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    out = mixing.arranged(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == 0


ODD = [(None, BASE), (None, NEAR), (None, None), (5, text(90)), (5, text(60)), (7, "seven words are here in this text"), (7, "seven words are here in this text"), (8, text(40)), (9, text(30))]


def test_mixing_of_repeated_ids(spark):
    """Rows without doc_id and rows that repeat one are drawn each for itself: what is planned is what is put out."""
    docs = spark.createDataFrame([(i, t, "s", f"r{k}", 1) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, source string, row_file string, size int")
    plan, out = mixing.mix(docs).collect(), mixing.arranged(docs).collect()
    assert sum(r["taken"] for r in plan) == sum(len(WORD.findall(r["text"])) for r in out)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in plan) == sorted((i or -1, len(WORD.findall(t or ""))) for i, t in ODD)
    assert mixing.arranged(docs).columns == docs.columns


def test_mixing_sql(docs):
    """The query's SQL gives the same rows, with null and repeated ids too."""
    import duckdb

    rows = [(i, t, s) for i, t, s in ROWS] + [(i, t, None) for i, t in ODD]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = sorted((tuple(r) for r in mixing.digest(mixing.mix(df)).collect()), key=key)
    assert got == sorted((tuple(None if x is not None and x != x else x for x in r) for r in con.sql(mixing.SQL).fetchall()), key=key)


def test_warc(spark):
    same = "<html>" + "y" * 200
    rows = [(3, "http://a/\r\nx", same), (1, None, same), (2, "u", "short"), (5, "u", "short"), (4, "u", None), (9, "u", "é" * 5000), (7, "u", same)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in warc.read(archives).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if html == same and i != 1 else ("response", None))
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == raw
    body = bytes(archives.first()["body"])
    assert len(list(warc.records(body))) >= 1
    with pytest.raises(ValueError):
        list(warc.records(body[:-3]))
    raw = warc.record(1, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), "response", None)
    import zstandard

    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = streamed.compress(raw) + streamed.flush()
    assert [b for _, b in warc.records(frame)] == [raw.partition(b"\r\n\r\n")[2][:-4]]
    with pytest.raises(ValueError):
        list(warc.records(frame[:10] + bytes([frame[10] ^ 255]) + frame[11:]))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def foreign(kind, fields, block, identity="<urn:uuid:12345678-1234-1234-1234-123456789abc>", version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", "WARC-Date: 2020-05-05T05:05:05Z", *fields, f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_warc_of_others(spark, tmp_path):
    """A file as other writers make it: a raw dictionary, warcinfo and request records, sha1 in base 32, uuids, folded headers, chunks, truncation."""
    import base64

    import zstandard

    samples = [f"<html><body>{' '.join(str(i * k) for k in range(60))}</body></html>".encode() for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    body = "<html>naïve</html>".encode() * 40
    sha1 = lambda x: "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    answer = lambda *fields: "\r\n".join(["HTTP/1.1 200 OK", *fields]).encode() + b"\r\n\r\n"
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(body[i : i + 100]), body[i : i + 100]) for i in range(0, len(body), 100)) + b"0\r\n\r\n"
    made = [
        foreign("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        foreign("request", [], b"GET / HTTP/1.1\r\n\r\n"),
        foreign("response", ["WARC-Target-URI: http://a/", sha1(body)], answer(f"Content-Length: {len(body)}") + body, "<urn:uuid:1>"),
        foreign("response", ["WARC-Target-URI:", "  http://b/", f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}"], answer() + body, "<urn:uuid:2>", "WARC/1.1"),
        foreign("response", [sha1(body)], answer("Transfer-Encoding: chunked") + chunks, "<urn:uuid:3>"),
        foreign("response", [sha1(chunks)], answer("transfer-encoding: Chunked") + chunks, "<urn:uuid:4>"),
        foreign("response", ["WARC-Truncated: length", sha1(body[:50])], answer(f"Content-Length: {len(body)}") + body[:50], "<urn:uuid:5>"),
        foreign("response", ["WARC-Payload-Digest: blake3:zz"], answer() + body, "<urn:uuid:6>"),
        foreign("revisit", ["WARC-Refers-To: <urn:uuid:1>", sha1(body)], b"", "<urn:uuid:7>"),
        foreign("metadata", [], b""),
    ]
    whole = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(packer.compress(r) for r in made)
    (tmp_path / "a.warc.zst").write_bytes(whole)
    (tmp_path / "b.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in made[:2]))  # no dictionary, no page
    got = {r["record_id"]: r for r in warc.read(warc.files(spark, f"{tmp_path}/*.warc.zst")).collect()}
    assert sorted(got) == [f"<urn:uuid:{i}>" for i in range(1, 8)] and {r["page_id"] for r in got.values()} == {None}
    for i in (1, 2, 3, 4, 6):
        r = got[f"<urn:uuid:{i}>"]
        assert (bytes(r["payload"]), r["payload_bytes"], r["payload_digest"], r["record_type"]) == (body, len(body), hashlib.sha256(body).hexdigest(), "response")
    assert (got["<urn:uuid:1>"]["url"], got["<urn:uuid:2>"]["url"]) == ("http://a/", "http://b/") and bytes(got["<urn:uuid:5>"]["payload"]) == body[:50]
    r = got["<urn:uuid:7>"]
    assert (r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["refers_to_id"]) == (None, None, None, None, "<urn:uuid:1>")
    for fields, block in (
        ([sha1(body + b"x")], answer() + body),  # another digest
        (["WARC-Payload-Digest: sha1:tooshort"], answer() + body),  # none
        ([], answer(f"Content-Length: {len(body) + 1}") + body),  # shorter than told
        ([], answer("Content-Length: +5") + body[:5]),
        ([], answer("Transfer-Encoding: chunked") + chunks[:-9]),
    ):
        with pytest.raises(ValueError):
            warc.page(*warc.parse(foreign("response", fields, block)))
    with pytest.raises(ValueError):
        warc.parse(foreign("response", [], b"x").replace(b"Content-Length: 1", b"Content-Length: 1_0"))


def test_surrogates(docs, empty, spark):
    t = "Mr. James Miller mailed a.b@mail.example.com, again a.b@mail.example.com; +1 (212) 555-0199, 10.0.0.1, 4111 1111 1111 1111, token = \"0641917ea4e9feb9\", Frau Müller"
    new, spans = surrogates.rewritten(t)
    kinds = [s["kind"] for s in spans]
    assert sorted(set(kinds)) == ["card", "email", "ip", "person", "phone", "secret"]
    for s in spans:
        assert new[s["new_start"] : s["new_end"]] != t[s["start"] : s["end"]]
    mails = [new[s["new_start"] : s["new_end"]] for s in spans if s["kind"] == "email"]
    assert mails[0] == mails[1] and mails[0].endswith(".example.com")
    assert surrogates.luhn(re.sub(r"\D", "", next(new[s["new_start"] : s["new_end"]] for s in spans if s["kind"] == "card")))
    assert new.split()[1] in surrogates.NAMES["latin", "m"]
    for n in (2, 3, 10, 97, 1000):
        values = [surrogates.permute(i, n, b"k", "l") for i in range(n)]
        assert sorted(values) == list(range(n)) and all(v != i for i, v in enumerate(values))
    out = surrogates.replace(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == len(ROWS)
    changed = {r["doc_id"] for r in out.collect() if r["entities"]}
    assert changed == {16}
    assert surrogates.collisions(docs).count() == 0 and surrogates.replace(empty).count() == 0


def test_surrogates_of_people():
    """Mentions of one person by parts of the name agree; endings that tell a gender stay; equal names agree over documents."""
    t = "Mr. James Miller came. Miller left; James too. Frau Petrova met Иван Смирнов. Millers stay."
    new, spans = surrogates.rewritten(t)
    assert not re.search(r"\b(James|Miller|Petrova|Иван|Смирнов)\b", new) and new.endswith("Millers stay.")
    given, name = re.match(r"Mr\. (\w+) (\w+) came\. (\w+) left; (\w+) too", new).group(1, 2)
    assert new.startswith(f"Mr. {given} {name} came. {name} left; {given} too") and given in surrogates.NAMES["latin", "m"]
    assert re.search(r"Frau \w+a met", new) and re.search(r"met \w+ \w+ов\.", new)
    assert surrogates.rewritten("Herr Miller")[0].split()[1] == name
    words = ["".join(x) for x in itertools.product("BDK", "aeo", "rs", "lmn", "aks")]
    assert len({surrogates.name_word(w, b"k") for w in words}) == len(words)
    pair = "token=0641917ea4e9feb9 token=487ndnl8n72w78gu"
    out = surrogates.rewritten(pair)[0].split()
    assert out[0] != out[1] and not set(out) & set(pair.split())


def test_secrets_of_two_kinds_never_meet():
    """Values that aren't hexadecimal get no hexadecimal surrogate, and different ones."""
    values = ["".join(v) for v in itertools.product("aeiou", repeat=6) if set(v) - set("ae")]
    new = [surrogates.rewritten(f"token = {v}")[0].split()[-1] for v in values]
    assert not [v for v in new if re.fullmatch("[0-9a-f]+", v)] and len(set(new)) == len(values)


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {i: t for i, t, _ in ROWS}
    encoded = pieces.encode(docs)
    for r in encoded.collect():
        t = texts[r["doc_id"]]
        assert (r["ids"], r["n_tokens"], r["round_trip"]) == ((None, None, None) if t is None else (sp.encode(t), len(sp.encode(t)), True))
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == texts
    assert pieces.encode(empty).count() == 0


def test_pieces_hard_texts():
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Transducer(pieces.load())
    for x in ["  a  b   c", " " * 40, "日本語 テキスト", "\n\n a\n", "😀😀", "tab\there", "    def f():\n        return 1", "привет мир", "a\x00b", "!!!!!!!!", "▁ x", "x" * 500]:
        assert t.encode(x).tolist() == sp.encode(x)
        assert [t.path(c) for c in t.chunks(t.normalised(x))] == [t.any_path(c) for c in t.chunks(t.normalised(x))]
    texts = ["", "a b", "\n", " x\n\n y ", "▁ z", "é" * 90, text(300)]
    ids, ends = t.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(x) for x in texts]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_pieces_compiled_normaliser(tmp_path, rule):
    """A model with a character map and white space taken together, as the library reads it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    m.trainer_spec.model_type = pieces.UNIGRAM
    held = "▁ a b c é ﬁ f i K ab ▁a ▁b bc fi １ 1 ... . ア ー".split()
    for i, (p, kind) in enumerate([("<unk>", 2), ("<s>", 3), ("</s>", 3), *[(x, 1) for x in dict.fromkeys(held)]]):
        m.pieces.add(piece=p, score=-0.37 * i - 1, type=kind)
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(pieces.load(path))
    for x in ["", "  a  b ", "ﬁ １２ ①", "e\u0301 ab\tc", "ＡＢＣ ｱｰ ｶﾞ", "a\u00a0b\u200bc", "İẞ", "   ", "…a\r\nb", "가 각", "x" * 70 + "ﬁ"]:
        assert t.encode(x).tolist() == sp.encode(x), x


def test_unigram_takes_the_shortest_path():
    model = {"kind": pieces.UNIGRAM, "prefix": False, "escape": True, "pieces": [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("ba", -2.5, 1), ("aba", -9.0, 1)]}
    t = pieces.Transducer(model)
    assert [t.text[i] for i in t.encode("aba")] == ["a", "ba"]


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = c.quality(spark, df, "")
    near = c.near_duplicates(spark, df, "").cache()
    want = {i for i, (_, root) in links_brute(c.NEAR_WORDS, c.NEAR_PERCENT).items() if root == i}
    assert kept.columns == near.columns == df.columns and {r["doc_id"] for r in near.collect()} == want
    clean = c.personal_data(spark, df, "").cache()
    assert clean.columns == df.columns and {r["doc_id"]: r["text"] for r in clean.collect()} == {i: surrogates.rewritten(t)[0] for i, t, _ in ROWS}
    assert c.mixed(spark, df, "").columns == df.columns
    assert [n for n, _ in c.STAGES] and c.encoded(spark, df, "").filter(F.col("round_trip") == F.lit(False)).count() == 0


@pytest.mark.parametrize("key", [surrogates.KEY, b"a", b"key two", b"3", b"another"])
def test_surrogates_of_all_short_names(key):
    """Walks end, and all names of two and three letters of a script have surrogates of their own, of the same shape, none its own."""
    for upper, lower in (("AEIOUBCDFGHJKLMNPQRSTVWXYZ", "aeiobcdgklmnrstvz"), ("АЕЁИОУБВГДЖЙКЛМНПР", "аеиоуйбвгдклнртя"), ("ΑΕΗΒΓΔΖΘ", "αεηβγδζθλνρς")):
        for n in (1, 2):
            words = [a + "".join(b) for a in upper for b in itertools.product(lower, repeat=n)]
            words = [w for w in words if not w.endswith("ς")]  # that letter stays, so a name can be alone with its shape
            new = [surrogates.name_word(w, key) for w in words]
            assert len(set(new)) == len(words) and not any(a == b for a, b in zip(words, new))
            kind = lambda w: [surrogates.PLACE[c][0] if c in surrogates.PLACE else c for c in w]
            assert all(kind(a) == kind(b) and surrogates.split_name(a)[1] == surrogates.split_name(b)[1] for a, b in zip(words, new))
    for word in ("Io", "Ee", "Йй", "Ae", "Ъъ", "Ωλ"):
        assert surrogates.name_word(word, key)


def test_surrogates_are_the_same_in_all_documents():
    """No document is rewritten under a key of its own because two of its names met."""
    names = ["Kim", "Lim", "Li", "Lo", "Ma", "Wu", "Ko", "Le", "Hu", "Ji", "Do", "Ba", "Io"]
    alone = {n: surrogates.rewritten(f"Mr. {n} came.")[0].split()[1] for n in names}
    together = surrogates.rewritten(" ".join(f"Mr. {n}," for n in names))[0].replace(",", "").split()[1::2]
    assert together == [alone[n] for n in names] and len(set(together)) == len(names)


def test_repeats_of_rows(spark):
    """Rows are told apart by place: a repeated doc_id with the same or another text, rows without doc_id; the session's settings stay."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    a, b, c = word(400), word(400), word(300)
    rows = [(3, a), (5, a), (5, b), (None, c + c), (None, b[:150]), (5, b), (2, word(50) + a[100:260]), (9, None), (9, ""), (None, None), (1, c[:120] + "é" * 60), (1, word(99))]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, want = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        want.append((rows[i][0] or -1, len(raw), sum(gone), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, doc int").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = repeats.digest(repeats.remove(df)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert spark.conf.get(name) == before


def test_repeats_batches_are_taken_in_small_parts():
    """A worker's memory goes with a slice of texts, not with the batch that Spark hands it, and marks are numbers of one text at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = ["é" * 50_000, None, "", *["x" * 90_000] * 30]
    marks = [[{"start": k, "size": 100} for k in range(n)] for n in (2, 0, 0, *[4000] * 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([m or None for m in marks], pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int64())])))], ["doc_id", "text", "marks"])
    tracemalloc.start()
    got = []
    for part in repeats.parts(batch, 1, 300_000):
        assert part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column(1).to_pylist()[:-1]) <= 300_000
        for i, t, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), repeats.marks_of(part.column(2))):
            assert t == texts[i] and m == [(x["start"], x["size"]) for x in marks[i]]
            got.append(i)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == list(range(len(texts))) and peak < 4_000_000
    assert list(repeats.parts(batch.slice(0, 0), 1, 300_000)) == []


def test_pipeline_of_an_empty_table(spark, tmp_path):
    """All stages take a table without rows."""
    import corpus_pipeline as c

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
