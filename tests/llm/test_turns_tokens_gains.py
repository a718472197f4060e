"""Conversation repair, token counts and importance resampling against brute-force versions on small awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import conversations, importance, ordering, token_counts

RNG = random.Random(11)
SPACE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- conversations


def conversations_rows():
    said = ["Yes.", "No", "", " \t", None, "Why?", "a. b! c?", "long " * 50 + "end.", "ok\n", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    rows = []
    for conv in range(60):
        for turn in range(RNG.randrange(1, 9)):
            if RNG.random() < 0.9:
                role = ("system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]) if RNG.random() < 0.7 else RNG.choice(roles)
                rows.append((conv, RNG.choice([turn] * 12 + [None, 3]), role, RNG.choice([*said, f"word {turn} here.", f"unlike {conv} {turn}"])))
    rows += [(None, t, RNG.choice(roles), RNG.choice(said)) for t in range(6)]
    rows += [(500, t, RNG.choice(roles), RNG.choice([*said, f"n{t % 40}."])) for t in range(90)]
    rows += [(501, 1, "user", "same.")] * 30 + [(502, None, "assistant", "same.")] * 9
    return rows + rows[:5]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(f, 1))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) for c, v in out.items()}


def repaired_brute(turns):
    """The least (cost, audit) over all edits, by plain recursion over what is left."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def least(i, emitted, inserted):
        """emitted: initials so far, shortened to what the grammar needs."""
        key = (i, emitted, inserted)
        if key not in best:
            ways = [(0, "", ())] if i == len(turns) and emitted in ("", "ua") else []
            if inserted < 2:
                for name in ("user", "assistant"):
                    ways += more(3, "I", emitted, name[0], (f"{name}:",), i, inserted + 1)
            if i < len(turns):
                cost, audit, said = least(i + 1, emitted, 0)
                ways.append((cost + 4, "D" + audit, said))
                if faults[i] not in ("blank", "duplicate"):
                    extra, (_, role, text) = 3 * (faults[i] == "truncated"), turns[i]
                    ways += more(extra, "K", emitted, role[:1], (f"{role}:{text}",), i + 1, 0)
                    for name in ("user", "assistant"):
                        ways += more(3 + extra, "R", emitted, name[0], (f"{name}:{text}",), i + 1, 0)
            best[key] = min(ways, default=(10**9, "", ()))
        return best[key]

    def more(cost, edit, emitted, initial, said, i, inserted):
        to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}.get((emitted, initial))
        if to is None:
            return []
        c, audit, rest = least(i, to, inserted)
        return [(cost + c, edit + audit, said + rest)]

    cost, audit, said = least(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    count = collections.Counter(faults)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("limits", [(1 << 15, 4 << 20), (4, 1 << 20), (1 << 15, 60)])
def test_conversations(spark, monkeypatch, limits):
    """Blocks of any size give the same repair; extra columns with names of the operator's own do no harm."""
    monkeypatch.setattr(conversations, "BLOCK_TURNS", limits[0])
    monkeypatch.setattr(conversations, "BLOCK_CHARS", limits[1])
    rows = conversations_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, block int, row_at string, copies int").repartition(3)
    out = conversations.repair(conversations.damage(df))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.digest(out).collect()}
    assert got == {c: repaired_brute(t) for c, t in damaged(rows).items()}
    initials = collections.defaultdict(str)
    for r in conversations.as_turns(out).orderBy("conv_id", "part", "place").collect():
        initials[r["conv_id"]] += r["role"][:1]
    assert initials and all(re.fullmatch("(s?(ua)+)?", x) for x in initials.values())


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(conversations.repair(conversations.damage(empty))).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    (row,) = conversations.digest(conversations.repair(conversations.damage(one))).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversations_sql(spark):
    rows = [r for r in conversations_rows() if r[0] != 502]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = duck.execute(conversations.SQL)
    names = [d[0] for d in cursor.description]
    got = {r[0]: tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()}
    assert got == {c: repaired_brute(t) for c, t in damaged(rows).items()}


# ---------------------------------------------------------------- token counts

ODD = "՘࢏Ᲊ꟎\U00010940\U000323b0"  # letters or not, by the version of Unicode
TEXTS = [
    None, "", " ", "plain words here", "it's we'll I'D they've", "a  b   c\n\n d\t\te \n", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z <|endof", "\x00\x01 nul", "  wide　space\u0085 ",
    "日本語のテキスト 한국어 العربية हिन्दी", f"{ODD} a{ODD}b 1{ODD}2 !{ODD}?", "½ ² ٣ Ⅷ 12345678901234567890", "🙂🙂👩‍👩‍👧 é", "y" * 5000, "word " * 3000, "-" * 700 + "!'s", "ab" * 40 + " " + "Zz9" * 60,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, monkeypatch, name):
    """Equal to the library's own counts, whatever tier answers: the first holds two pre-tokens, the cache three."""
    monkeypatch.setattr(token_counts, "FREQUENT", 2)
    monkeypatch.setattr(token_counts, "CACHE", 3)
    path = token_counts.model_file(name)
    rows = [(None if i == 4 else i, t, "n", 1) for i, t in enumerate([*TEXTS, TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, pre int").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count(df, path).collect())
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = [len(library.encode(t or "")) for _, t, *_ in rows]
    else:
        from tokenizers import Tokenizer

        n = [len(e) for e in Tokenizer.from_file(path).encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False)]
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(rows, n))
    assert token_counts.count(df.limit(0), path).count() == 0


def test_pre_tokens_of_all_characters():
    """Every code point, beside a letter, a number, a sign and a space, is cut as the library cuts it."""
    from tokenizers import Tokenizer

    raw = token_counts.load(token_counts.model_file())[1]
    counter = token_counts.TokenCounter("bytes", raw, *token_counts.cuts())
    library = Tokenizer.from_str(raw.decode()).pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (0x20000 <= c < 0x3FF80 and c % 64) and not (0x40000 <= c and c % 997)]
    for i in range(0, len(points), 500):
        s = "".join(f"\na{c}1{c}!{c} {c}\n" for c in map(chr, points[i : i + 500]))
        assert counter.cut(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)], hex(points[i])


def test_special_strings_that_look_around():
    """Special strings that take spaces with them are left to the library."""
    import json

    from tokenizers import Tokenizer

    told = json.loads(token_counts.load(token_counts.model_file())[1])
    told["added_tokens"][0] |= {"lstrip": True, "rstrip": True}
    counter = token_counts.TokenCounter("bytes", json.dumps(told).encode(), *token_counts.cuts())
    library = Tokenizer.from_str(json.dumps(told))
    for t in ("a  <|endoftext|>  b", " <|endoftext|> ", "none here"):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False))


# ---------------------------------------------------------------- importance


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [*w, *[a + b" " + b for a, b in zip(w, w[1:])]]


def resampled_brute(docs, target, percent=25, least=20):
    s, t = (collections.Counter(zlib.crc32(f) % 10_000 for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        n, fs = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in (zlib.crc32(f) % 10_000 for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    long = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    take = percent * len(long) // 100
    ranks = {id(r): k for k, r in enumerate(long[:take], 1)}
    return sorted((-1 if r[0] is None else r[0], *r[1:4], ranks.get(id(r))) for r in out)


def importance_rows():
    words = ["data", "Data", "model", "é", "naïve", "日本", "x1", "the", "THE", "q" * 70, "r" * 400, "İ"]
    rows = [(i, " ".join(RNG.choice(words) for _ in range(RNG.randrange(0, 60)))) for i in range(150)]
    return [*rows, (None, "the " * 30), (None, "the " * 30), (900, None), (901, ""), (902, "!?\x00 \x7f"), (3, rows[3][1]), (3, rows[4][1]), (903, "a-b_c.d  e\n" * 2000)]


def test_importance(spark, monkeypatch):
    rows, target = importance_rows(), ["the data model", "é data", None, "q" * 70 + " " + "r" * 400]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, bucket string").repartition(4)
    wanted = resampled_brute(rows, target)
    for nodes in (1 << 18, 3):
        monkeypatch.setattr(importance, "NODES", nodes)
        monkeypatch.setattr(importance, "SLICE", 1 << 22 if nodes > 3 else 500)
        got = importance.resample(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in got) == wanted
    assert importance.resample(df.limit(0), df.limit(0)).count() == 0


def test_importance_sql():
    rows, target = importance_rows(), ["the data model", "é data", None]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    duck.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(target)))
    got = duck.execute(importance.SQL).fetchall()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == resampled_brute(rows, target)


def test_ranked(spark):
    """Numbers without a gap in the order asked for, with one value held by most rows."""
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("v"), (F.col("id") * 7919 % 5000).alias("u"), F.lit(1).alias("rank_part"))
    got = ordering.ranked(df, [F.desc("v"), F.asc("u")], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001)) and [(r["v"], r["u"]) for r in got] == sorted(((r["v"], r["u"]) for r in got), key=lambda x: (-x[0], x[1]))
    tied = ordering.ranked(df.withColumn("v", F.lit(1)), [F.desc("v")], "rank").select("rank").collect()
    assert sorted(r["rank"] for r in tied) == list(range(1, 5001))
