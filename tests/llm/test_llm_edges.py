"""Every operator and stage on odd tables: nulls, repeats, no rows, a text of 5 MB, and columns named like internal ones."""

import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyad.llm import bpe, decontam, doubling, exact, quality, sharding, simhash, substrings, token_counts
from polyad.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INTERNAL = (
    "id sub row digest content bytes tokens of block k1 k2 cell shard slot rank cuts start label good wanted_id wanted_good score keep gone gone_sub node "
    "component u v t m c n pos fp rep bucket anchor spans copies doc doc_sub windows first item item_id similarity n_tokens ids decoded n_bytes over_limit kept text_sha256 "
    "__text __digest __id __dropped_id __rank __cell __block __p __start __rn"
).split()
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join("w%d" % (i * i % 99991) for i in range(850_000))
ROWS = [
    (1, "One two three four five six seven", "en", "s", 30),
    (1, "One two three four five six seven", "en", "s", 30),
    (1, "another text of the same id here", None, None, None),
    (None, "One two three four five six seven", "en", "s", 30),
    (None, None, None, None, None),
    (2, None, "en", "s", 0),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 4),
    (5, LONG, "en", "big", len(LONG)),
]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in INTERNAL}).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))


def items(spark):
    return spark.createDataFrame([(1, "another text of the same id here"), (2, None), (None, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))


OPS = {
    "shards": lambda s, d: sharding.uniform_shards(d, 3),
    "counts": lambda s, d: token_counts.count_tokens(d, WORD, new_path(s, "cache"), blank_runs_count=False),
    "substrings": lambda s, d: substrings.drop_repeated_substrings(d),
    "bpe": lambda s, d: bpe.encode_decode(d, BYTE),
    "score": lambda s, d: quality.score(d, labels(s)),
    "keep_good": lambda s, d: quality.keep_good(d, labels(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near": lambda s, d: simhash.drop_near_duplicates(d),
    "exact": lambda s, d: exact.exact_duplicates(d),
    "drop_exact": lambda s, d: exact.drop_exact_duplicates(d),
    "contaminated": lambda s, d: decontam.contaminated(d, items(s)),
    "drop_contaminated": lambda s, d: decontam.drop_contaminated(d, items(s)),
    "windows": lambda s, d: doubling.drop_repeated_windows(d),
}
#: Rows of ROWS that stay, by place, of what filters; of exact copies and near ones the first by id stays, null before all.
STAY = {"keep_good": Counter(range(9)), "drop_exact": Counter([2, 3, 7, 8]), "near": Counter([2, 3, 4, 5, 6, 7, 8]), "drop_contaminated": Counter([0, 1, 3, 4, 5, 6, 7, 8])}


@pytest.mark.parametrize("name", OPS)
def test_odd_tables(spark, name):
    df = table(spark, ROWS)
    got = OPS[name](spark, df)
    rows = got.collect()
    if name in STAY:
        assert got.columns == df.columns and all(r[c] == 7 for r in rows for c in INTERNAL)
        at = Counter((r["doc_id"], r["text"]) for r in rows)
        assert at == Counter({k: n for k, n in Counter((ROWS[i][0], ROWS[i][1]) for i in STAY[name].elements()).items()})
    elif name == "contaminated":
        assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 1)]
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    assert OPS[name](spark, table(spark, ROWS).limit(0)).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    d = str(tmp_path)
    items(spark).write.parquet(f"{d}/benchmark.parquet")
    labels(spark).write.parquet(f"{d}/labels.parquet")
    for name, rows in (("some", ROWS), ("none", [])):
        docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in INTERNAL if c not in ("n_tokens", "ids", "decoded")})
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, d)
            if stage != "bpe_encoding":
                assert out.columns == docs.columns
                path = new_path(spark, "odd")
                out.write.parquet(path)
                docs = spark.read.parquet(path)
        assert {r["round_trip"] for r in out.collect()} == ({True} if rows else set())


def words(r, n):
    return ["w%d" % r.randrange(5000) for _ in range(n)]


def test_chains_of_three_lose_no_link(spark):
    """Neighbours of a chain are near copies, its ends need not be: all three are one group."""
    r, rows = random.Random(9), []
    for k in range(60):
        a = words(r, 400)
        b, c = list(a), None
        for i in r.sample(range(400), 6):
            b[i] = "x%d" % r.randrange(10**6)
        c = list(b)
        for i in r.sample(range(400), 6):
            c[i] = "y%d" % r.randrange(10**6)
        three = [a, b, c]
        r.shuffle(three)
        rows += [(10 * k + j, " ".join(t), "en", "s", 1) for j, t in enumerate(three)]
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t, *_ in rows}
    least = {d: d for d in sets}
    for _ in range(2):
        for k in range(60):
            for i in range(3):
                for j in range(3):
                    x, y = 10 * k + i, 10 * k + j
                    if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                        least[x] = least[y] = min(least[x], least[y])
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(least.values())


def test_pipeline_equals_loops(spark):
    """run() against loops over its documents, from those on that the classifier keeps."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = quality.keep_good(docs, spark.read.parquet(f"{d}/labels.parquet")).select("doc_id", "text").collect()
    groups = {}
    for r in good:
        groups.setdefault("".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(r["text"] or ""), r["doc_id"], r["text"] or ""))
    rows = [min(g)[1:] for g in groups.values()]
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    rows = [(i, t) for i, t in rows if least[i] == i]
    bench = [(t or "").lower().encode().split() for (t,) in duckdb.sql(f"SELECT text FROM '{d}/benchmark.parquet'").fetchall()]

    def shingled(w):
        return Counter(decontam.shingles(w).tolist())

    kept = {}
    for i, t in rows:
        w = t.lower().encode().split()
        near = lambda a: any((lambda x, y: sum((x & y).values()) >= 0.8 * sum((x | y).values()))(shingled(a), shingled(w[p : p + len(a)])) for p in range(max(1, len(w) - len(a) + 1)))
        grams = set(decontam.shingles(w).tolist())
        if not any(a and w and grams & set(decontam.shingles(a).tolist()) and near(a) for a in bench):
            kept[i] = t
    out = corpus_pipeline.run(spark, d).collect()
    encoder = bpe.encoder_of(BYTE)
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: len(encoder.encode(t)) // 4 for i, t in kept.items()}
    assert {r["round_trip"] for r in out} == {True}
