import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyad import schema
from polyad.functions import text as T
from polyad.functions.similarity import indel_ratio, lcs_length, token_sort_ratio, token_sort_ratio_col
from polyad.operators import curation, graph, mentions, relations, resolution, signed, topics
from polyad.operators.numbering import numbered


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def plain_distance(a, b, edits):
    if not edits:
        return len(a) + len(b) - 2 * plain_lcs(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_lcs(a, b):
    assert lcs_length(a, b) == plain_lcs(a, b)
    assert indel_ratio(a, b) == indel_ratio(b, a)


def test_ratio_column(spark):
    df = spark.createDataFrame([("ana perez", "perez ana"), ("x", None), ("abcd", "abxd")], "a string, b string")
    got = [r[0] for r in df.select(token_sort_ratio_col(F.col("a"), F.col("b"))).collect()]
    assert got == [100, None, token_sort_ratio("abcd", "abxd")] == [100, None, 75]


def test_vocabularies():
    assert len(schema.ACT_TYPES) == 9 and {"endorses", "attacks"} <= set(schema.ACT_TYPES)
    assert set(schema.POLARITIES) == {"positive", "negative", "neutral"} and len(schema.NODE_TYPES) == 6


def test_constraints(spark):
    nodes = spark.createDataFrame([("a", "A", "person"), ("a", None, "org")], "node_id string, canonical string, node_type string")
    aliases = spark.createDataFrame([(1, "a", "x", "x"), (2, "z", "y", "x")], "alias_id long, node_id string, surface_form string, surface_norm string")
    got = {(r["tab"], r["rule"]): r["violations"] for r in schema.check_constraints({"nodes": nodes, "aliases": aliases}).collect()}
    assert got["nodes", "unique node_id"] == 1 and got["nodes", "not null canonical"] == 1
    assert got["aliases", "unique surface_norm"] == 1 and got["aliases", "foreign node_id"] == 1
    assert set(schema.empty_tables(spark)) == set(schema.TABLES)


def test_scalars(spark):
    df = spark.createDataFrame([("  ÁÉÍ-Ñandú, x ", "2019-03-05", "```json\n{}\n```"), (None, "2019", "x")], "s string, d string, f string")
    r = df.select(T.normalize(F.col("s")).alias("n"), T.try_date(F.col("d")).alias("d"), T.strip_fence(F.col("f")).alias("f"), T.hash_fraction(F.col("s")).alias("h"), T.canonical_polarity(F.lit("Positivo")).alias("p")).collect()
    assert r[0]["n"] == "aeinandu x" and str(r[0]["d"]) == "2019-03-05" and r[0]["f"] == "{}" and r[0]["p"] == "positive"
    assert r[1]["n"] is None and r[1]["d"] is None and 0 <= r[0]["h"] < 1


def test_merge_keeps_best(spark):
    raw = spark.createDataFrame([("a", 0, "Boric", "persona", 0.5), ("a", 1, "boric", "persona", 0.9), ("a", 2, "BORIC", "persona", 0.9), ("a", 3, "Boric", "x", 0.1), ("a", 4, " ", "x", 1.0)], "article_id string, ord int, text string, label string, score double")
    body = spark.createDataFrame([("a", "El boric")], "article_id string, body string")
    got = {(r["text"], r["type"]): r["char_span"] for r in mentions.merge(raw, body).collect()}
    assert set(got) == {("boric", "person"), ("Boric", "x")} and got["boric", "person"]["start"] == 3 and got["Boric", "x"] is None


def test_tagger_and_roll_up(spark):
    arts = spark.createDataFrame([("a", "Boric y la UDI")], "article_id string, body string")
    assert {r["text"] for r in mentions.tag(arts, {"persona": ["boric"], "organización": ["udi"]}).collect()} == {"Boric", "UDI"}
    ents = spark.createDataFrame([("a", 0, "Boric", "person", ["Boric", "GB"]), ("b", 0, "Gabriel Boric", "person", ["GB"]), ("c", 0, "Kast", "person", [])], "article_id string, ord int, canonical string, type string, surface_forms array<string>")
    got = {r["canonical"]: (r["n_articles"], r["surface_forms"]) for r in mentions.roll_up(ents).collect()}
    assert got == {"Gabriel Boric": (2, ["Boric", "GB", "Gabriel Boric"]), "Kast": (1, ["Kast"])}


def one_loop(rows, cutoff=90, surname=88):
    """The rule in words, over all surfaces and without components: clusters by the most similar form that may be joined."""
    founder, forms, out = {}, {}, []
    for i, (surface, kind, _, ns) in enumerate(rows):
        if ns not in founder:
            best = (0, 0)
            for other, home in founder.items():
                long = {t for t in ns.split() if len(t) >= 4} & {t for t in other.split() if len(t) >= 4}
                score = token_sort_ratio(ns, other)
                types = {kind, rows[home][1]}
                person = "person" in types and token_sort_ratio(ns.split()[-1], other.split()[-1]) < surname
                if long and score >= cutoff and (len(types) == 1 or "unknown" in types) and not person:
                    best = max(best, (score, -home)) if best[0] else (score, -home)
            founder[ns] = -best[1] if best[0] else i
        out.append((surface, founder[ns]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_one_loop(spark, seed):
    r = random.Random(seed)
    first, last = ["alberto", "teodoro", "gabriel", "camila"], ["espina", "espinoza", "ribera", "boric", "vallejo"]
    rows = {}
    for _ in range(60):
        name = f"{r.choice(first)} {r.choice(last)}"
        if r.random() < 0.4:
            i = r.randrange(len(name))
            name = name[:i] + r.choice("aeiou") + name[i + 1 :]
        rows[r.choice(["", "senador "]) + name] = (r.choice(["person", "person", "org", "unknown"]), r.randint(1, 9))
    mentions_ = [(s, t, f) for s, (t, f) in rows.items()]
    df = spark.createDataFrame(mentions_, "surface string, type string, freq long")
    assign, nodes = resolution.resolve(df)
    prepared = [tuple(x) for x in resolution.prepared(df).select("surface", "type", "freq", "ns").collect()]
    ordered = sorted(prepared, key=lambda x: (-x[2], x[0]))
    want = {}
    for s, head in one_loop(ordered):
        want.setdefault(ordered[head][0], set()).add(s)
    got = {}
    for x in assign.collect():
        got.setdefault(x["node_id"], set()).add(x["surface"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sum(n["n"] for n in nodes.collect()) == sum(f for *_, f in mentions_)


def test_fuzzy_names(spark):
    index = spark.createDataFrame([("gabriel boric", "E1"), ("jose kast", "E2")], "form string, entity_id string")
    names = spark.createDataFrame([("Gabriel Boric",), ("Gabriel Borik",), ("KAST José",), ("nadie",), ("",)], "surface string")
    got = {r["surface"]: r["entity_id"] for r in resolution.resolve_names(names, index).collect()}
    assert got == {"Gabriel Boric": "E1", "Gabriel Borik": "E1", "KAST José": "E2", "nadie": None, "": None}


def grouped(rows):
    out = {}
    for n, c in rows:
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


def test_communities_of_a_planted_partition(spark):
    r = random.Random(3)
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcd" for i in range(12) for j in range(i) if r.random() < 0.7]
    edges += [(f"{g}{r.randrange(12)}", f"{h}{r.randrange(12)}", 0.5) for g in "abcd" for h in "abcd" if g < h for _ in range(4)]
    links = spark.createDataFrame(edges, "u string, v string, w double")
    got = [tuple(x) for x in signed.modularity_communities(links).collect()]
    assert grouped(got) == [sorted(f"{g}{i}" for i in range(12)) for g in "abcd"]
    assert signed.modularity(edges, dict(got)) == pytest.approx(signed.modularity(edges, {n: n[0] for n, _ in got}))
    sized = signed.communities(links).collect()
    assert {(x["community"], x["size"]) for x in sized} == {(k, 12) for k in range(4)} and {x["community"] for x in sized if x["node_id"][0] == "a"} == {0}
    assert signed.communities(links.limit(0)).count() == 0


def test_communities_gain_and_settle(spark):
    """Pairs, a ring and a loop: neighbours don't swap for ever, and no single move gains any more."""
    edges = [("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "c", 1.0), ("g", "g", 2.0), ("g", "a", 0.1)]
    got = dict(tuple(x) for x in signed.modularity_communities(spark.createDataFrame(edges, "u string, v string, w double")).collect())
    most = signed.modularity(edges, got)
    assert all(signed.modularity(edges, got | {n: c}) <= most + 1e-9 for n in got for c in set(got.values()))


def test_period_and_top(spark):
    edges = spark.createDataFrame([("a", "b", "2020"), ("a", "c", "2021"), ("b", "a", "2021")], "from_node_id string, to_node_id string, period string")
    assert signed.in_period(edges, "2021").count() == 2 and signed.in_period(edges, None).count() == 3
    assert graph.among(edges, spark.createDataFrame([("a",), ("b",)], "node_id string")).count() == 2


def test_rules_file():
    rules = relations.rules_from_json('{"id": "x", "validation": {"require_evidence_substring": false, "min_quote_len": 3, "max_relations_per_article": null, "allowed_act_types": ["attacks"], "dedup": false, "other": 1}}')
    assert rules == relations.Rules(require_evidence=False, min_quote_len=3, max_per_article=None, act_types=("attacks",), dedup=False)
    assert relations.rules_from_json("{}") == relations.Rules()


def test_embeddings(spark):
    from polyad.operators import topics

    arts = spark.createDataFrame([("a", "Paz", "uno dos"), ("b", None, "tres"), ("c", "", "uno dos paz")], "article_id string, title string, body string")
    got = {r["id"]: r["embedding"] for r in topics.embed_hashed(arts, 64).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values()) and got["a"] == pytest.approx(got["c"]) and got["a"] != got["b"]

    def model(frames):
        for f in frames:
            yield f.assign(embedding=f["text"].map(lambda t: [float(len(t))]))[["id", "embedding"]]

    assert {r["id"]: r["embedding"] for r in topics.embed_with(arts, model).collect()} == {"a": [11.0], "b": [4.0], "c": [11.0]}


def test_candidates_and_fuzzy_queries(spark, smallest):
    """The registered queries without SQL against loops."""
    from polyad.plans import fixtures as fx
    from polyad.plans import registry

    nodes = sorted(registry._ranked(spark, smallest).collect(), key=lambda r: (-r["degree"], r["node_id"]))[:150]
    want = {(min(a["node_id"], b["node_id"]), max(a["node_id"], b["node_id"]), token_sort_ratio(a["canonical"].lower(), b["canonical"].lower())) for i, a in enumerate(nodes) for b in nodes[:i] if a["node_type"] == b["node_type"]}
    assert {(r["a"], r["b"], r["ratio"]) for r in registry.QUERIES["curation_candidates"](spark, smallest).collect()} == {x for x in want if x[2] >= 85}
    norm = lambda names: [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.normalize(F.col("n"))).collect()]
    forms = {}
    for i, (n, form) in enumerate(zip(fx.NAMES, norm(fx.NAMES))):
        forms[form] = f"E{i % 5}"
    for r in registry.QUERIES["gazetteer_resolve"](spark, smallest).collect():
        name = norm([r["surface"]])[0]
        best = min(((-token_sort_ratio(name, f), f) for f in forms), default=None)
        assert r["entity_id"] == forms.get(name, forms[best[1]] if -best[0] >= 85 else None)
    prepared = [tuple(x) for x in resolution.prepared(fx.surfaces(spark, smallest)).select("surface", "type", "freq", "ns").collect()]
    ordered = sorted(prepared, key=lambda x: (-x[2], x[0]))
    got = [(r["surface"], r["node_id"]) for r in registry.QUERIES["er_resolve"](spark, smallest).collect()]
    assert grouped(got) == grouped(one_loop(ordered))


def test_degree_sum(spark):
    edges = spark.createDataFrame([("a", "b", "positive"), ("a", "a", "negative"), ("b", "c", "neutral")], "from_node_id string, to_node_id string, polarity string")
    nodes = spark.createDataFrame([(n, n, "person") for n in "abcd"], "node_id string, canonical string, node_type string")
    table = {r["node_id"]: r["degree"] for r in graph.signed_degree(nodes, edges).collect()}
    assert sum(table.values()) == 6 and table["d"] == 0 and table["a"] == 3
    view = {r["node_id"]: r["degree"] for r in graph.signed_degree_view(nodes, edges).collect()}
    assert view == {"a": 2, "b": 2, "c": 1}


def test_close_pairs_of_many_forms(spark, monkeypatch):
    """Forms that fill several blocks, share common and rare tokens, and are longer than a machine word, against a loop."""
    monkeypatch.setattr(resolution, "BLOCK", 40)
    monkeypatch.setattr(resolution, "RARE", 12)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdñ") for _ in range(r.randrange(3, 8)))
    known = [word() for _ in range(60)]
    names = {" ".join(r.choice(known[:4] if r.random() < 0.5 else known) for _ in range(r.randrange(1, 5))) for _ in range(300)}
    names |= {n[:-1] + r.choice("abcd") for n in list(names)[:80]} | {" ".join(known[k : k + 14]) + " " + word() for k in range(3) for _ in range(6)} | {"x" * 300 + " " + known[0], "x" * 299 + " " + known[0]}
    names = sorted({" ".join(n.split()) for n in names})
    shares = lambda a, b: any(len(t) >= 4 for t in set(a.split()) & set(b.split()))
    forms = spark.createDataFrame([(n,) for n in names], "form string")
    for edits in (True, False):
        sized = forms.withColumn("by", F.col("form") if edits else T.token_sort(F.col("form")))
        got = sorted(tuple(x)[:3] for x in resolution.close_pairs(sized, 20, 4, edits).collect())
        by = {n: n if edits else " ".join(sorted(n.split())) for n in names}
        far = {(a, b): plain_distance(by[a], by[b], edits) for i, a in enumerate(names) for b in names[i + 1 :] if shares(a, b)}
        assert got == sorted((a, b, d) for (a, b), d in far.items() if d <= (len(by[a]) + len(by[b])) * 20 // 100) and len(got) > 50
        assert max(len(a) for a, _, _ in got) > 200


def test_blocked_pairs_ratio(spark):
    names = ["ana maria perez", "perez ana maria", "ana maria peres", "mario perez", "ana perez maria soto", "perez", "soto vial juan"]
    got = {tuple(x) for x in resolution.blocked_pairs(spark.createDataFrame([(n,) for n in names], "ns string"), 80).collect()}
    shares = lambda a, b: any(len(t) >= 4 for t in set(a.split()) & set(b.split()))
    want = {(a, b, token_sort_ratio(a, b)) for a in names for b in names if a < b and shares(a, b)}
    assert got == {x for x in want if x[2] >= 80} and len(got) > 3


@pytest.mark.parametrize("block", [60, 45])
def test_close_pairs_of_rings_of_blocks(spark, monkeypatch, block):
    """Blocks that meet in several tasks, with names and last tokens: pairs of two strict forms need similar last tokens."""
    monkeypatch.setattr(resolution, "BLOCK", block)
    monkeypatch.setattr(resolution, "RARE", 8)
    monkeypatch.setattr(resolution, "SPAN", 2)
    r = random.Random(block)
    ends = ["gonzalezperez", "gonzalesperez", "rojas", "rojos", "soto"]
    names = sorted({f"{r.choice(['ana', 'eva', 'maria'])} {'comun ' if r.random() < 0.8 else ''}{''.join(r.choice('abcde') for _ in range(4))} {r.choice(ends)}" for _ in range(400)})
    rows = [(7 * i, n, " ".join(sorted(n.split())), n.split()[-1], r.random() < 0.6) for i, n in enumerate(names)]
    forms = spark.createDataFrame(rows, "name long, form string, by string, last string, strict boolean")
    got = sorted(tuple(x) for x in resolution.close_pairs(forms, 10, 4, edits=False).select("a", "b", "d", "same").collect())
    want = []
    for i, (a, f, by, last, strict) in enumerate(rows):
        for b, g, other, end, also in rows[i + 1 :]:
            d, same = plain_distance(by, other, False), token_sort_ratio(last, end) >= 88
            if d <= (len(by) + len(other)) * 10 // 100 and {t for t in f.split() if len(t) >= 4} & set(g.split()) and (same or not (strict and also)):
                want.append((a, b, d, same))
    assert got == sorted(want) and {x[3] for x in got} == {True, False}


def test_few_tasks_compare_forms_of_a_common_token(spark):
    forms = spark.range(6000).select(F.concat(F.lit("comun "), F.md5(F.col("id").cast("string"))).alias("form")).withColumn("by", F.col("form"))
    assert resolution.close_pairs(forms, 10, 4).rdd.getNumPartitions() <= 4


def test_components_share_tasks(spark, monkeypatch):
    """Whatever number of tasks assigns components, clusters are those of one loop; nodes beyond 99,999 have ids of their own."""
    r = random.Random(5)
    names = sorted({f"{r.choice(['alberto', 'teodora', 'gabriel'])} {''.join(r.choice('aeo') for _ in range(3))}{r.choice(['espina', 'riberas', 'vallejo'])}" for _ in range(120)})
    df = spark.createDataFrame([(n, r.choice(["person", "org", "unknown", None]), r.randint(1, 4)) for n in names] + [(names[0].upper(), "org", 9)], "surface string, type string, freq long")
    ordered = sorted((tuple(x) for x in resolution.prepared(df).select("surface", "type", "freq", "ns").collect()), key=lambda x: (-x[2], x[0]))
    number = resolution.numbered
    monkeypatch.setattr(resolution, "numbered", lambda rows, name, *order: number(rows, name, *order).withColumn(name, F.col(name) + 99_990))
    for pairs in (resolution.PAIRS, 40):
        monkeypatch.setattr(resolution, "PAIRS", pairs)
        assign, nodes = resolution.resolve(df)
        got = [(x["surface"], x["node_id"]) for x in assign.collect()]
        assert grouped(got) == grouped(one_loop(ordered)) and len(got) == len(ordered) > len(set(n for _, n in got)) > 20
        assert {n for _, n in got} == {x["node_id"] for x in nodes.collect()} and {"N99990", "N100000"} <= {n for _, n in got}


def test_spanning_edges(spark, monkeypatch):
    """Edges in several lots a partition: the components stay, and edges are fewer than nodes."""
    monkeypatch.setattr(resolution, "PAIRS", 50)
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    found = resolution.spanning(df)
    joined = lambda e: grouped([tuple(x) for x in resolution.components(e).collect()])
    assert joined(found) == joined(df) and found.count() < len({n for e in edges for n in e})


def test_parity_compares_by_hash(spark):
    """Null names and types, a name that looks like another's type, an article in one set only, and no comparison of structs each with each."""
    left = [("x", "Ana", "person"), ("x", "ANA", "person"), ("x", None, "person"), ("y", "a", "1:b"), ("z", "q", None)]
    right = [("x", "ana", "person"), ("x", "Bob", "person"), ("y", "b=a", "1"), ("w", "q", None)]
    a, b = (spark.createDataFrame(rows, "article_id string, text string, type string") for rows in (left, right))
    df = mentions.parity(a, b)
    sets = [{}, {}]
    for s, rows in zip(sets, (left, right)):
        for k, t, y in rows:
            s.setdefault(k, set()).add((t and t.lower(), y))
    keys = set(sets[0]) | set(sets[1])
    both = [(sets[0].get(k, set()), sets[1].get(k, set())) for k in keys]
    got = df.first()
    assert (got["articles"], got["lost"], got["gained"]) == (len(keys), sum(len(x - y) for x, y in both), sum(len(y - x) for x, y in both))
    assert abs(got["mean_jaccard"] - sum(len(x & y) / len(x | y) for x, y in both) / len(keys)) < 1e-9
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString() and "array<struct" not in df._jdf.queryExecution().analyzed().toString()


def test_terms_of_repeated_ids(spark, monkeypatch):
    """Rows of one id count as one document, also without an id, and cells that many terms share add none."""
    texts = [(i, i % 2, "uno dos %s tres" % ("comun" if i < 5 else "raro%d" % i)) for i in range(12)] + [(20, 0, "gato gato perro")] * 6 + [(None, 1, "luna sol")] * 6 + [(30, 0, None), (31, 1, "")]
    docs, want = spark.createDataFrame(texts, "id long, topic_id int, text string"), {}
    for cells in (topics.CELLS, 64):
        monkeypatch.setattr(topics, "CELLS", cells)
        df, tf, seen = topics.terms(docs, 5, ["tres"]), {}, {}
        for i, k, t in texts:
            w = [x for x in (t or "").split() if x != "tres"]
            for x in w + [f"{p} {q}" for p, q in zip(w, w[1:])]:
                tf[k, x] = tf.get((k, x), 0) + 1
                seen.setdefault(x, set()).add((i, k))
        want = {(*k, n) for k, n in tf.items() if len(seen[k[1]]) >= 5}
        assert {tuple(r) for r in df.select("topic_id", "term", "tf").collect()} == want and want
    scratch = [p for p in df.inputFiles()]
    assert scratch and all("common-terms" in p for p in scratch)


def test_known_pairs_of_names_with_several_nodes(spark):
    """A name that several nodes have stands for all of them; a pair without edges has net 0, and an unknown polarity isn't counted."""
    nodes = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "A"), ("4", "C")], "node_id string, canonical string")
    edges = spark.createDataFrame([("1", "2", "positive"), ("2", "3", "positive"), ("3", "2", None), ("1", "3", "negative"), ("3", "3", "negative")], "from_node_id string, to_node_id string, polarity string")
    expected = spark.createDataFrame([("A", "B", "pos"), ("C", "A", "neg"), ("A", "A", "neg"), ("A", "D", "pos")], "a string, b string, expect string")
    got = {tuple(r) for r in signed.known_pairs(edges, nodes, expected).collect()}
    assert got == {("A", "B", "pos", 2, 2), ("C", "A", "neg", 0, 0), ("A", "A", "neg", -3, 3)}


def test_curation(spark):
    nodes = spark.createDataFrame([("n1", "UDI", "party", 3, 2), ("n2", "Unión Demócrata Independiente", "party", 9, 1), ("n3", "unión demócrata independiente", "org", 1, 1), ("n4", "Otro", "org", 0, 1)], "node_id string, canonical string, node_type string, degree int, n_mentions int")
    aliases = spark.createDataFrame([("n4", "una forma larga"), ("n1", "udi")], "node_id string, surface_norm string")
    pairs = curation.evidence(nodes, aliases)
    got = {(r["node_id"], r["merge_into"]) for r in curation.propose(nodes, pairs).collect()}
    assert got == {("n1", "n2"), ("n3", "n2")}
    cur = spark.createDataFrame([("a", "b", "Congreso Nacional"), ("b", None, "Senado de la República"), ("c", "d", "DC"), ("d", "c", "Democracia"), ("e", "a", "PS")], "node_id string, merge_into string, canonical string")
    safe, held = (set(map(tuple, x.collect())) for x in curation.merge_map(cur))
    assert ("a", "b") in held and ("e", "b") in safe and ("c", "c") in safe


def test_validation_rules(spark):
    rows = spark.createDataFrame([("a", i, "Boric", "Matthei", "accuses", "negative", q) for i, q in enumerate(["Boric fue criticado por Matthei", "Boric fue criticado por Matthei", "no está en el texto", "Boric"])], "article_id string, ord int, from_entity string, to_entity string, act_type string, polarity string, evidence_quote string")
    body = spark.createDataFrame([("a", "Ayer Boric fue criticado por Matthei.")], "article_id string, body string")
    got = {r["ord"]: (r["from_entity"], r["rejected"]) for r in relations.validate(rows, body).collect()}
    assert got[0] == ("Matthei", None) and got[1][1] == "duplicate" and got[2][1] == "quote_not_in_body" and got[3][1] == "quote_too_short"


def test_numbered(spark):
    got = numbered(spark.range(50).repartition(7), "n", "id").collect()
    assert all(r["id"] == r["n"] for r in got) and len(got) == 50


def test_database_and_export(spark, tmp_path):
    from polyad.sources import lake

    assert lake.init_database(spark, "graphdb") == sorted(schema.TABLES)
    nodes = spark.createDataFrame([("a", "A", "person"), ("b", "B", "party"), ("c", "C", "org")], "node_id string, canonical string, node_type string")
    edges = spark.createDataFrame([("a", "b", "x", "attacks", "negative", "i", "2020")], "from_node_id string, to_node_id string, article_id string, act_type string, polarity string, issue string, period string").withColumn("publish_date", F.lit("2020-01-01").cast("date"))
    arts = spark.createDataFrame([("x", "s", 2020, "2020")], "article_id string, source string, year int, period string").withColumn("publish_date", F.lit("2020-01-01").cast("date"))
    got = lake.export_public(nodes, edges, arts, str(tmp_path / "out"))
    assert got["exported"] == {"nodes": 2, "edges": 1, "articles_meta": 1} and got["polarity"] == {"negative": 1} and got["years"] == [2020, 2020]


def test_model_interfaces(spark):
    def reply(frames):
        for f in frames:
            yield f.rename(columns={"key": "article_id", "prompt": "text"})

    rows = relations.extract_with(spark.createDataFrame([("k", '{"relations": [{"from_entity": "a", "to_entity": "b"}]}'), ("z", "no")], "key string, prompt string"), reply)
    assert [(r["article_id"], r["from_entity"], r["act_type"]) for r in relations.explode_replies(rows).collect()] == [("k", "a", None)]
