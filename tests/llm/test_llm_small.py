"""Training-data operators against brute force on small tables, with nulls, blanks, ties, repeats, clashing names and empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyad.llm import bpe, chat, decontam, doubling, exact, quality, queries, sharding, simhash, substrings, token_counts, windows
from polyad.llm.common import new_path

DOCS = "doc_id long, text string"
BLANK = r"[\x20\x09-\x0D]"


@pytest.fixture(scope="module")
def docs():
    """Texts of the smallest table, copies, near copies, shared passages, periodic and odd ones."""
    r = random.Random(5)
    base = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id < 90").fetchall()
    extra = [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (504, "one  TWO"), (505, "x" * 99), (506, "x" * 100), (507, "ab" * 900)]
    for k in range(40):
        w = r.choice(base)[1].split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "é%d" % r.randint(0, 99)
        extra.append((600 + k, " ".join(w)))
    passage = " ".join("p%d" % r.randint(0, 9999) for _ in range(50))
    extra += [(700 + k, " ".join("h%d" % r.randint(0, 99999) for _ in range(20)) + " " + passage + " t%d" % k) for k in range(60)]
    extra += [(800 + k, " ".join(r.choice(["aa", "bb"]) for _ in range(200))) for k in range(5)]
    return base + extra


def frame(spark, rows):
    """With an extra column whose name clashes with results, in another case."""
    return spark.createDataFrame(rows, DOCS).withColumns({"SHARD": F.lit("x"), "Kept": F.lit(1), "n_TOKENS": F.lit(2), "Ids": F.lit(0)}).repartition(3)


def dig(b):
    return hashlib.sha256(b).hexdigest()


def test_shards(spark, docs):
    rows = docs + [docs[3]] * 3 + [(None, "no id")]
    got = sharding.uniform_shards(frame(spark, rows), 7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.uniform_shards(spark.createDataFrame([], DOCS), 4).count() == 0
    assert sharding.uniform_shards(spark.range(3).toDF("doc_id"), 8).select("shard").distinct().count() == 3


def test_op1_query(spark):
    d = "/root/testdata/sf0.001"
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()}
    got = queries.op1_sharding(spark, d).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(want)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_shards_of_ties_and_one_hot_block(spark):
    """Rows that are equal, or share an id, each get a slot, and the same ones however the rows are dealt out."""
    rows = [(1, "a")] * 700 + [(1, None)] * 300 + [(1, "b%d" % k) for k in range(200)] + [(None, None)] * 50
    one, two = (sorted(sharding.uniform_shards(spark.createDataFrame(rows, DOCS).repartition(n), 4).collect(), key=str) for n in (1, 5))
    assert one == two and Counter(r["shard"] for r in one) == {0: 313, 1: 313, 2: 312, 3: 312}
    assert all(sorted(r["slot"] for r in one if r["shard"] == s) == list(range(312 + (s < 2))) for s in range(4))


def test_shards_are_uniform(spark):
    where = Counter()
    for seed in range(30):
        for r in sharding.uniform_shards(spark.range(40).toDF("doc_id").coalesce(1), 4, seed=seed).collect():
            where[r["doc_id"] < 20, r["shard"]] += 1
    chi = sum((n - 150) ** 2 / 150 for n in where.values())
    assert len(where) == 8 and chi < 30


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 9, 4], sharding.shard_sizes(18, 5), 1)
    assert [sum(r) for r in m] == [5, 0, 9, 4] and [sum(c) for c in zip(*m)] == [4, 4, 4, 3, 3]
    rng = np.random.default_rng(0)
    big = [sharding._hypergeometric(rng, 2 * 10**9, 3 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 400) < 5 and 12 < np.std(big) < 19
    big = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 2 * 10**9) for _ in range(300)]
    sd = (2e9 * 0.75 * 0.25 * 0.5) ** 0.5
    assert abs(np.mean(big) - 1.5e9) < 0.3 * sd and 0.8 * sd < np.std(big) < 1.2 * sd


def test_exact(spark, docs):
    rows = docs + [(d + 2000, (t or "").replace(" ", "\n")) for d, t in docs[:20]]
    got = {r["doc_id"]: r for r in exact.exact_duplicates(frame(spark, rows), support=0.01).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(BLANK, "", t or ""), []).append((-len(t or ""), d))
    for norm, g in groups.items():
        keep = min(g)[1]
        for _, d in g:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(g), d == keep, dig(norm.encode()))
    kept = exact.drop_exact_duplicates(frame(spark, rows))
    assert kept.count() == len(groups) and "SHARD" in kept.columns
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    two = exact.exact_duplicates(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], DOCS)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["kept"]) for r in two) == {(None, None, True): 1, (1, None, False): 2}


def chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), ro or "", tx or "") for cc, t, ro, tx in rows if cc == c)
        out[c] = [(ro, tx) for _, ro, tx in turns]
    return out


def test_chat(spark):
    rows = [(1, 0, "user", "<|end|>&amp;&lt;|"), (1, 1, "assistant", "a<"), (1, 2, "assistant", "|b <|part|>"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "as<|text|>", "\n"), (3, 0, "assistant", ""), (None, 1, "user", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Formatted", F.lit(1))
    assert all("".join(x["text"] for x in r["segments"]) == r["formatted"] for r in chat.format_chats(df).collect())
    got = chat.format_chats(df).select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).collect()
    want = chats(rows)
    for r in got:
        assert [(t["role"], t["text"]) for t in r["t"]] == want[r["conv_id"]]
        assert r["l"] == "".join(x for ro, x in want[r["conv_id"]] if ro == "assistant")
    assert next(r for r in got if r["conv_id"] == 1)["formatted"].count("<|turn|>") == 2
    assert chat.format_chats(spark.createDataFrame([], df.schema)).count() == 0


BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_transducer_equals_library():
    tok, enc = Tokenizer.from_file(BYTE), bpe.Encoder(bpe.MergeList(BYTE))
    dec, r = bpe.Decoder(enc.merges), random.Random(2)
    old = bpe.CHUNK, bpe.LONG_RUN
    bpe.CHUNK, bpe.LONG_RUN = 53, 41
    try:
        for _ in range(400):
            k = r.random()
            if k < 0.4:
                x = "".join(r.choice("ab c\n\t '<|>é1") for _ in range(r.randint(0, 300)))
            elif k < 0.7:
                x = r.choice(["a", "ab", " ", "\n ", "!", "1", "é", "<|", "の"]) * r.randint(0, 2500) + r.choice(["x", " y", ""])
            else:
                x = "".join(r.choice(["<|endoftext|>", "<|endof", " ", "a" * 30, " " * 70, "'re", "'r"]) for _ in range(20))
            want = tok.encode(x, add_special_tokens=False).ids
            got = enc.encode(x)
            assert np.frombuffer(got, "<u4").tolist() == want
            assert dec.decode(got) == tok.decode(want, skip_special_tokens=False)
    finally:
        bpe.CHUNK, bpe.LONG_RUN = old


def test_encode_decode(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    text = dict(docs)
    for r in bpe.encode_decode(frame(spark, docs), BYTE).collect():
        ids = tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids) and r["decoded"] == (text[r["doc_id"]] or "")
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_token_counts(spark, docs):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "cache")
    tok, text = Tokenizer.from_file(path), dict(docs)
    for part in (docs[:60], docs, docs):
        for r in token_counts.count_tokens(frame(spark, part), path, cache, blank_runs_count=False).collect():
            n = len(tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((text[r["doc_id"]] or "").encode()), n > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), path, new_path(spark, "cache")).count() == 0
    pieces = token_counts.count_tokens(spark.createDataFrame([(1, "a b"), (2, None)], DOCS), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "cache"))
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.collect()}[2] == 0


def test_token_cache_is_used(spark, docs):
    """A second run encodes nothing; another tokenizer version does."""
    path, cache = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "cache")
    rows = docs + docs[:5] + [(None, "x" * (3 * token_counts.GROUP_CHARS)), (None, None)]
    first = sorted(map(str, token_counts.count_tokens(frame(spark, rows), path, cache).collect()))
    n = spark.read.parquet(cache).count()

    again = sorted(map(str, token_counts.count_tokens(frame(spark, rows), path, cache).collect()))
    assert again == first and len(first) == len(rows) and spark.read.parquet(cache).count() == n
    token_counts.count_tokens(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), cache).count()
    assert spark.read.parquet(cache).count() == 2 * n


def test_token_counts_of_pieces(monkeypatch):
    """Sums over pieces equal the library's counts of whole texts, and the library sees each different piece once."""
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    tok, seen = Tokenizer.from_file(path), []

    class Watched:
        no_truncation = no_padding = lambda self: None

        def encode(self, text, **kw):
            seen.append(text)
            return tok.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Watched())
    count = token_counts._counter.__wrapped__(path)
    latin = [chr(i) for i in range(256)]
    odd = ["'s", "'RE", "''ll", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "a\u0301", "\u0301b", "\u0130", "\u03a3\u03a3", "\u2019s", "\ufb01", "\u4e2d\u6587", "\U0001f600", "\u2126", "\u0e01\u0e33", "\u1100\u1161", "\u2003", "\u180e", "\u200b", "\u0660", "\u2160", "\ufeff", "x", "É", " ", "  ", "\n", "9", "_", "¼", "ª"]
    texts = ["", " "] + [a + b + c for a in latin for b in latin for c in ("", "s 7")] + ["".join(r.choice(odd + latin) for _ in range(r.randint(1, 30))) for _ in range(4000)]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(1, 30))) for _ in range(4000)] + ["y" * 70_000, "é'" * 20_000]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert count(part) == [len(x.ids) for x in tok.encode_batch(part, add_special_tokens=False)]
    words = ["".join(r.choice("abcdeéè") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(100)]
    seen.clear()
    assert count(texts) + count(texts) == 2 * [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, seen)) <= 2 * sum(map(len, words))


def test_token_counts_forget_pieces(monkeypatch):
    """Counts stay right when a worker's memory of pieces is full again and again, and where pieces don't repeat."""
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 600)
    count = token_counts._counter.__wrapped__(path)
    texts = [" ".join("".join(r.choices("abcdeé", k=6)) for _ in range(20)) for _ in range(60)]
    want = {x: len(tok.encode(x, add_special_tokens=False).ids) for x in texts}
    sizes, known = set(), dict(zip(count.__code__.co_freevars, count.__closure__, strict=True))["known"].cell_contents
    for x in texts:
        assert count([x, x, x, "<|endoftext|> " + x]) == 3 * [want[x]] + [want[x] + 1]
        sizes.add(len(known))
    assert 0 in sizes and len(sizes) > 2
    for x in [" ".join("".join(r.choices("fghij", k=9)) for _ in range(20)) for _ in range(20)]:
        assert count([x]) == [len(tok.encode(x, add_special_tokens=False).ids)] and len(known) <= 200


def test_blank_runs(spark):
    """Runs of white space become one space, as one pattern after the other on single characters gives it."""
    blanks, r = [" ", "\n", "\t", "\x0b", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"], random.Random(6)
    texts = ["".join(r.choice(blanks + ["a", "b", " ", "\x1c", "\u200b", "\u180e", "\ufeff"]) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [" \n" * 300_000 + "x"]
    got = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", token_counts.normalised(F.col("text"), False).alias("t")).collect()
    assert {x["doc_id"]: x["t"] for x in got} == {k: re.sub("[" + "".join(blanks) + "]+", " ", t).strip(" ") for k, t in enumerate(texts)}


def brute_bytes(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), dig(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def brute_words(rows, n=35):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    count = Counter(tuple(w[p : p + n]) for w in words.values() for p in range(len(w) - n + 1))
    out = {}
    for d, w in words.items():
        gone = [0] * len(w)
        for p in range(len(w) - n + 1):
            if count[tuple(w[p : p + n])] > 1:
                gone[p : p + n] = [1] * n
        out[d] = (len(w), sum(gone), dig(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def got_bytes(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), dig(bytes(r["kept"]))) for r in substrings.drop_repeated_substrings(df).collect()}


def got_words(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], dig(r["kept"].encode())) for r in doubling.drop_repeated_windows(df).collect()}


@pytest.mark.parametrize("common", [1e-3, 1.0])
def test_repeated_windows(spark, docs, common, monkeypatch):
    monkeypatch.setattr(windows, "COMMON_SHARE", common)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 1 << 15)
    df = frame(spark, docs)
    assert got_bytes(df) == brute_bytes(docs)
    assert got_words(df) == brute_words(docs)


def test_windows_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert substrings.drop_repeated_substrings(empty).count() == doubling.drop_repeated_windows(empty).count() == 0
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    # Rows that repeat an id, with one text and with another one.
    rows = [(1, t), (1, t), (1, u), (3, "q " + t), (None, u), (None, None), (2, None), (2, "short")]
    twice = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("id", "sub", "text_", "copies", "spans", "start", "anchor", "kept", "N_words")}).repartition(3)
    got = doubling.drop_repeated_windows(twice).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"]) for x in got) == {(1, 60, 60): 3, (3, 61, 60): 1, (None, 60, 60): 1, (None, 0, 0): 1, (2, 0, 0): 1, (2, 1, 0): 1}
    got = substrings.drop_repeated_substrings(twice).collect()
    n = len(t)
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in got) == {(1, n, 0): 1, (1, n, n): 2, (3, n + 2, n): 1, (None, n, 0): 1, (None, 0, 0): 1, (2, 0, 0): 1, (2, 5, 0): 1}


@pytest.mark.parametrize("op", [substrings, doubling])
def test_only_the_method_removes(spark, docs, op, monkeypatch):
    """With classes in which every window stands once nothing goes, not even of exact copies."""
    s, window, size = op.SCHEME, op.SCHEME.window, op.SCHEME.symbols(b"").itemsize

    def apart(contents, copies):
        n = sum(len(c) // size - window + 1 for c in contents)
        return np.arange(n), np.ones(n)

    monkeypatch.setattr(op, "SCHEME", windows.Scheme(s.window, s.anchor, s.stretch, s.symbols, apart, s.keep_first))
    run = {substrings: substrings.drop_repeated_substrings, doubling: doubling.drop_repeated_windows}[op]
    assert run(frame(spark, docs + [(9000 + d, t) for d, t in docs[:10]])).agg(F.sum("n_removed").alias("n")).first()["n"] == 0


def test_hot_passage_meets_by_its_surroundings(monkeypatch):
    """Around a passage of many documents windows have anchors of their own, once its anchors are common."""
    r = random.Random(2)
    passage = bytes(r.choices(b"abcdefgh", k=80))
    texts = [bytes(r.choices(b"ijklmnop", k=90)) + passage + bytes(r.choices(b"ijklmnop", k=90)) for _ in range(300)]
    common = windows.NONE_COMMON.copy()
    cells = windows.gram_hashes(np.frombuffer(passage, np.uint8), substrings.ANCHOR) >> np.uint64(64 - windows.CELL_BITS)
    common[cells.astype(np.int64)] = 1
    plain, ordered = (windows.cut([(i, 0) for i in range(300)], texts, substrings.SCHEME, c) for c in (windows.NONE_COMMON, common))
    assert max(Counter(plain["anchor"].tolist()).values()) > 200 and max(Counter(ordered["anchor"].tolist()).values()) < 60


def test_long_texts_break_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 700)
    text = bytes(random.Random(1).choices(b"abcdefgh", k=5000))
    r = windows.cut([(1, 0)], [text], substrings.SCHEME)
    starts = sorted(s for x in r for s in range(x["start"], x["start"] + x["windows"]))
    assert starts == list(range(len(text) - 99))
    monkeypatch.undo()
    r = random.Random(2)
    words = " ".join("l%d" % r.randrange(10**6) for _ in range(120_000))
    rows = [(1, words), (2, "x " + words[300_000:700_000]), (3, words[-2000:])]
    assert got_bytes(spark.createDataFrame(rows, DOCS)) == brute_bytes(rows)
    assert got_words(spark.createDataFrame(rows, DOCS)) == brute_words(rows)


def test_interval_expansion():
    r = random.Random(3)
    for _ in range(120):
        n, letters = r.choice([5, 12, 40]), r.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        pool = [bytes(r.choices(letters, k=r.randint(1, 90))) for _ in range(4)]
        texts = [b"".join(r.choices(pool, k=r.randint(0, 4))) for _ in range(r.randint(1, 10))]
        strings = [t[i : i + n] for t in texts for i in range(len(t) - n + 1)]
        got = substrings.string_classes(texts, n).tolist()
        assert len(got) == len(strings) and len(set(got)) == len(set(strings)) == len(set(zip(got, strings)))


def brute_components(rows, radius=2):
    fps = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, format(fps[i], "016x"), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("small", [32, 2])
def test_simhash(spark, docs, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    got = simhash.near_duplicates(frame(spark, docs)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(docs)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def similar(rows):
    """Pairs of documents whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = [(d, set(simhash.shingle_hashes((t or "").encode(), 5).tolist())) for d, t in rows]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x & y and len(x & y) >= 0.8 * len(x | y)}


@pytest.mark.parametrize("small", [32, 4])
def test_verified_near_duplicates(spark, docs, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    r, base = random.Random(4), docs[3][1].split()
    rows = docs + [(4000 + k, " ".join(w if r.random() > 0.006 else "zz%d" % k for w in base)) for k in range(80)]
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    pairs = similar(rows)
    left = {p for p in pairs if set(p) <= kept}
    gone = {d for d, _ in rows} - kept
    assert len(left) <= 0.02 * len(pairs) and len(gone) > 60
    assert all(any(d in p for p in pairs) for d in gone) and {500, 501, 502} <= kept
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def damaged(r, base, kind, k):
    """A copy of the words with one kind of change."""
    n = len(base)
    own = ["own%d_%d" % (k, i) for i in range(n // (20 if kind == "block" else 10))]
    at = r.randrange(n - len(own))
    return {"appended": base + own, "cut": base[: n - len(own)], "block": base[:at] + own + base[at + len(own) :], "scattered": [w if r.random() > 0.015 else "zz%d" % k for w in base]}[kind]


@pytest.mark.parametrize("kind", ["appended", "cut", "block", "scattered"])
def test_near_duplicates_of_each_kind(spark, kind):
    r, rows = random.Random(6), []
    for k in range(60):
        base = ["w%d" % r.randrange(3000) for _ in range(r.randrange(60, 300))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(damaged(r, base, kind, k)))]
    pairs = similar(rows)
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert len(pairs) > 20 and kept == {d for d, _ in rows} - {b for _, b in pairs}


def test_near_duplicates_go_by_fingerprints_first(spark, monkeypatch):
    """Close fingerprints are looked up and what they link is compared exactly; pairs that lie beyond the radius are found as well."""
    r, calls = random.Random(11), []
    base = ["w%d" % r.randrange(3000) for _ in range(300)]
    far = ["v%d" % r.randrange(3000) for _ in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base).upper()), (4, " ".join(far)), (5, " ".join(far + ["own%d" % i for i in range(8)])), (6, None), (7, " ")]
    found = simhash.fingerprint_pairs

    def spy(texts, words, radius):
        calls.append((words, radius, {tuple(sorted(p)) for p in found(texts, words, radius).collect()}))
        return found(texts, words, radius)

    monkeypatch.setattr(simhash, "fingerprint_pairs", spy)
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert calls == [(5, 2, {(1, 2), (1, 3)})] and kept == {1, 4, 6, 7}


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates_are_components(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    r, rows = random.Random(7), []
    for g in range(25):
        base = ["g%dw%d" % (g, r.randrange(3000)) for _ in range(200)]
        copies = [base] + [damaged(r, base, "scattered", 10 * g + k) for k in range(8)]
        rows += [(d, " ".join(w)) for d, w in zip(r.sample(range(100 * g, 100 * g + 100), 9), copies)]
    pairs, least = similar(rows), {d: d for d, _ in rows}
    for _ in range(9):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(least.values())


def test_masks_cover():
    r = random.Random(0)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for _ in range(500):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not diff & m for m in masks)


def test_decontamination(spark, docs):
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall() + [(900, None), (901, "tiny item"), (902, "")]
    r, rows = random.Random(1), docs[:40] + [(2000, "here is a TINY item"), (2001, None)]
    for k in range(80):
        w = [x if r.random() > 0.02 else "zz" for x in (r.choice(items)[1] or "q").split()]
        rows.append((3000 + k, " ".join([*["aa", "bb"] * r.randint(0, 5), *w, "cc"])))

    def sh(v):
        return Counter([" ".join(v[i : i + 5]) for i in range(len(v) - 4)] if len(v) >= 5 else [" ".join(v)])

    want = set()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, it in items:
            a = (it or "").lower().split()
            if a and w and any((lambda A, B: sum((A & B).values()) >= 0.8 * sum((A | B).values()))(sh(a), sh(w[p : p + len(a)])) for p in range(max(1, len(w) - len(a) + 1))):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.contaminated(frame(spark, rows), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    clean = decontam.drop_contaminated(frame(spark, rows), bench)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and "SHARD" in clean.columns
    assert decontam.contaminated(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    got = quality.score(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in got if not (r["quality"] == 1 and r["toxic"] == 0)]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_quality_writes_bounded_sets_in_few_files(spark, monkeypatch):
    """With many shuffle partitions, which nothing puts together, bounded sets aren't dealt over as many files, and no score changes."""
    d, wrote, plain = "/root/testdata/sf0.001", [], quality.materialize

    def noted(df, tag):
        wrote.append((tag, out := plain(df, tag)))
        return out

    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    expected = sorted(quality.score(docs, labels).collect())
    monkeypatch.setattr(quality, "materialize", noted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(quality.score(docs, labels).collect()) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tag for tag, _ in wrote} == {"labelled", "features", "confident", "pseudo"}
    assert all(len(df.inputFiles()) <= 16 for tag, df in wrote if tag != "confident")


def test_quality_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "a", "en", "s", 1), (None, "", "en", "s", 0)], schema)
    labels = spark.createDataFrame([(1, None, None), (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in quality.score(docs, labels).collect()] == [True] * 3
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    known = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 11)) and "pipeline" in known
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() <= seen.count()
            seen = out
    assert {r["round_trip"] for r in out.collect()} == {True}
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = known[name](spark, d)
        cols = sorted(df.columns)
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(con.sql(sql).project(", ".join(cols)).fetchall())


def test_spans_keep_their_type_in_every_batch(spark):
    """A batch without any span, and one with, come from the same task."""
    docs = spark.createDataFrame([(i, 0, "ab" * 60, 1) for i in range(40)], "id long, sub long, text string, copies long").coalesce(1)
    spans = spark.createDataFrame([(39, 0, 0, 3)], "doc long, doc_sub long, start long, windows long")
    for module, size in ((substrings, 120), (doubling, 1)):
        schema = "id bigint, n bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept " + ("binary" if size > 1 else "string")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = windows.apply_spans(docs, spans, schema, module._row).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["id"], r["n"]) for r in got) == [(i, size) for i in range(40)]
