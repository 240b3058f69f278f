"""Entity resolution: surface forms to nodes, precision first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.functions.similarity import Strings, alphabet_of, close, indel, may_reach, token_sort_ratio_col
from polyad.functions.text import last_token, normalize, strip_role, token_count, token_sort, tokens
from polyad.operators.components import components
from polyad.operators.numbering import numbered
from polyad.session import bound_batches
from polyad.sources.scratch import materialize

CUTOFF = 90
SURNAME_CUTOFF = 88
MIN_TOKEN = 4


def gazetteer(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(form, canonical): one canonical name per normalised form.

    ``entries`` (ord, canonical, surface_forms) go first, by ``ord``; then ``seeds`` (ord, name), which are their own names.
    """
    known = entries.filter(F.trim(F.coalesce("canonical", F.lit(""))) != "").select(F.lit(0).alias("prio"), "ord", F.trim("canonical").alias("canonical"), F.explode(F.array_union(F.array("canonical"), F.coalesce("surface_forms", F.array().cast("array<string>")))).alias("name"))
    rows = known.unionByName(seeds.select(F.lit(1).alias("prio"), "ord", F.col("name").alias("canonical"), "name"))
    forms = rows.withColumn("form", normalize(F.col("name"))).filter("form <> ''")
    return forms.groupBy("form").agg(F.min_by("canonical", F.struct("prio", "ord", "canonical")).alias("canonical"))


def gazetteer_index(entries: DataFrame) -> DataFrame:
    """(form, entity_id) of entries (ord, entity_id, canonical, aliases): the last entry that has a form wins."""
    rows = entries.select("ord", F.coalesce("entity_id", "canonical").alias("entity_id"), F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("canonical", F.lit(""))))).alias("name"))
    return rows.withColumn("form", normalize(F.col("name"))).filter("form <> ''").groupBy("form").agg(F.max_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id"))


def best_match(names: DataFrame, forms: DataFrame, cutoff: int) -> DataFrame:
    """(name, form, ratio): of ``names`` (name, normalised) the most similar form of at least ``cutoff``, the first by text on a tie.

    Names and forms meet in bands of equal sorted-token length and by a shared letter count bound; every pair that can reach
    the cutoff shares a band, since their lengths differ by at most a fixed share.
    """
    low = cutoff / (200.0 - cutoff)  # shorter over longer length of a pair that can reach the cutoff
    width = F.lit(8)
    size = lambda c: F.length(F.array_join(F.array_sort(tokens(c)), " "))
    a = names.withColumn("__n", size(F.col("name"))).withColumn("__band", F.explode(F.sequence(F.floor(F.floor(F.col("__n") * low) / width), F.floor(F.ceil(F.col("__n") / low) / width))))
    b = forms.select("form").distinct().withColumn("__band", F.floor(size(F.col("form")) / width))
    pairs = a.join(b, "__band").filter(may_reach(F.col("name"), F.col("form"), cutoff)).select("name", "form")
    scored = pairs.withColumn("ratio", token_sort_ratio_col(F.col("name"), F.col("form"))).filter(F.col("ratio") >= cutoff)
    return scored.groupBy("name").agg(F.min_by("form", F.struct(-F.col("ratio"), "form")).alias("form"), F.max("ratio").alias("ratio"))


def resolve_names(surfaces: DataFrame, index: DataFrame, fuzzy: bool = True, cutoff: int = 85) -> DataFrame:
    """``surfaces`` (surface) with ``entity_id``: by the exact form, else by the most similar one, else null."""
    named = surfaces.withColumn("name", normalize(F.col("surface")))
    exact = named.join(index.withColumnRenamed("form", "name"), "name", "left")
    if not fuzzy:
        return exact.select("surface", "entity_id")
    exact = materialize(exact, "exact")
    open_ = exact.filter("entity_id IS NULL AND name <> ''").select("name").distinct()
    near = best_match(open_, index, cutoff).join(index, "form").select("name", F.col("entity_id").alias("__near"))
    return exact.join(near, "name", "left").select("surface", F.coalesce("entity_id", "__near").alias("entity_id"))


def prepared(mentions: DataFrame, strip_roles: bool = True) -> DataFrame:
    """(surface, type, freq) with ``ns``: the normalised form, for persons without titles where two tokens are left."""
    ns = normalize(F.col("surface"))
    rows = mentions.withColumn("ns", ns).filter("ns <> ''")
    if strip_roles:
        bare = strip_role(F.col("ns"))
        rows = rows.withColumn("ns", F.when((F.col("type") == "person") & (token_count(bare) >= 2), bare).otherwise(F.col("ns")))
    return rows


#: Forms of a block; tokens of at most so many forms share bins; blocks that a block meets in one task; most tasks that compare.
BLOCK, RARE, SPAN, TASKS = 16384, 256, 16, 2000
#: Pairs of similar forms that one task may assign whatever components they make.
PAIRS = 1_000_000


def _matrix(lists: pa.Array, fill: int) -> np.ndarray:
    """Lists of numbers as columns, filled to the longest."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((int(n.max(initial=0)), len(n)), fill, np.int64)
    out[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(table: pa.Table) -> pa.Table:
    """One row for a block: its forms in order of length and tokens, as bytes."""
    forms = table.drop_columns(["bin", "block", "blocks"]).append_column("__n", pc.utf8_length(table["by"]))
    forms = forms.take(pc.sort_indices(forms, sort_keys=[("__n", "ascending"), ("g", "ascending")])).drop_columns(["__n"]).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, forms.schema) as stream:
        stream.write_table(forms)
    return table.select(["bin", "block", "blocks"]).slice(0, 1).append_column("forms", pa.array([out.getvalue().to_pybytes()], pa.binary()))


def _everywhere(side: Strings, t: np.ndarray, token: int) -> np.ndarray:
    """Of each part, whether all forms have the token."""
    return np.logical_and.reduceat((t == token).any(axis=0), side.starts)


def _met(left: pa.Table, right: pa.Table | None, own: int, share: int, edits: bool) -> Iterator[pa.RecordBatch]:
    """Close pairs of the forms of two blocks of the bin ``own``, or of one block."""
    sides = [left] if right is None else [left, right]
    texts = [side["by"].to_pylist() for side in sides]
    alphabet = alphabet_of(*texts)
    x, *rest = (Strings(side, alphabet) for side in texts)
    y = rest[0] if rest else x
    # Ends are filled with other numbers on either side.
    s, t = _matrix(left["t"].combine_chunks(), -1), _matrix(sides[-1]["t"].combine_chunks(), -2)
    bins = _matrix(left["bins"].combine_chunks(), -1)
    # Parts that have all a token before this bin's own in common meet there.
    skip = np.zeros((len(x.starts), len(y.starts)), bool)
    before, often = np.unique(s[(s == bins) & (s < own)] if (s == own).any() else s[:0], return_counts=True)
    for token in before[np.argsort(-often)[:64]]:
        skip |= _everywhere(x, s, token)[:, None] & _everywhere(y, t, token)[None, :]
    a, b = left["name"].combine_chunks(), sides[-1]["name"].combine_chunks()
    strict = "strict" in left.column_names
    if strict:
        person = [side["strict"].combine_chunks().to_numpy(zero_copy_only=False) for side in (left, sides[-1])]
    for p, q, d in close(x, y, share, edits, skip):
        first, open_ = np.zeros(len(p), bool), np.ones(len(p), bool)
        for k in range(len(s)):
            mine = s[k][p]
            hit = open_ & np.logical_or.reduce([mine == c[q] for c in t])
            first |= hit & (bins[k][p] == own)
            open_ &= ~hit
        p, q, d = p[first], q[first], d[first]
        extra = {}
        if strict and len(p):
            same = _same_last(left["last"].take(pa.array(p)), sides[-1]["last"].take(pa.array(q)))
            use = same | ~(person[0][p] & person[1][q])
            p, q, d, extra = p[use], q[use], d[use], {"same": pa.array(same[use])}
        if len(p):
            n = x.n[p] + y.n[q]
            u, v = a.take(pa.array(p)), b.take(pa.array(q))
            less = pc.less(u, v)
            yield pa.RecordBatch.from_pydict({"a": pc.if_else(less, u, v), "b": pc.if_else(less, v, u), "d": pa.array(d.astype(np.int32)), "n": pa.array(n.astype(np.int32)), **extra})


def _same_last(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Of each two last tokens, whether they are as similar as those of persons must be."""
    both = pa.chunked_array([*left.chunks, *right.chunks]).combine_chunks().dictionary_encode()
    texts, codes = both.dictionary.to_pylist(), both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    u, v, of = codes[: len(left)], codes[len(left) :], Strings(texts, alphabet_of(texts))
    out, most = u == v, (of.n[u] + of.n[v]) * (100 - SURNAME_CUTOFF) // 100
    open_ = np.flatnonzero(~out & (np.abs(of.n[u] - of.n[v]) <= most) & (np.bitwise_count(of.signs[u] ^ of.signs[v]) <= most))
    pairs, where = np.unique(u[open_] * len(texts) + v[open_], return_inverse=True)
    apart = np.array([indel(texts[k // len(texts)], texts[k % len(texts)]) for k in pairs.tolist()], np.int64)
    out[open_] = apart[where] <= most[open_]
    return out


def close_pairs(forms: DataFrame, share: int, min_token: int, edits: bool = True) -> DataFrame:
    """(a, b, d, n): pairs a < b of ``forms`` (form, by), one row per form, that share a token of this length and whose ``by`` are close.

    The distance ``d``, edits or insertions and deletions, is at most ``share`` percent of both lengths together, ``n``.
    Forms meet in a bin per token, where rare tokens share bins. A bin is cut into blocks, and each two blocks are compared
    in arrays: lengths, counts of characters and signatures rule out most pairs, the others are compared exactly. A pair
    that shares several tokens counts in the bin of the first one alone, so no pair comes twice.

    Where ``forms`` has ``name``, a and b are names. Where it has ``last`` and ``strict``, pairs have ``same``, whether their
    last tokens are similar, and pairs of two strict forms whose last tokens aren't similar are left out.
    """
    if "name" not in forms.columns:
        forms = forms.withColumn("name", F.col("form"))
    carried = [c for c in ("name", "by", "last", "strict") if c in forms.columns]
    bound_batches(forms.sparkSession)
    words = forms.select("form", *carried, F.explode(F.array_distinct(F.filter(tokens(F.col("form")), lambda t: F.length(t) >= min_token))).alias("t")).withColumn("t", F.xxhash64("t"))
    counts = materialize(words.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "token-counts")
    rare = counts.filter(F.col("n") <= RARE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = counts.select("t", F.when(F.col("n") > RARE, F.col("t")).otherwise(F.pmod("t", F.lit(1 + rare // max(1, BLOCK // 4)))).alias("bin"))
    rows = materialize(words.join(bins, "t").groupBy(*carried).agg(F.sort_array(F.collect_list(F.struct("t", "bin"))).alias("m")), "token-rows")
    common = F.transform(F.filter("m", lambda x: x["t"] == x["bin"]), lambda x: x["t"])
    each = rows.select(*carried, F.col("m.t").alias("t"), F.col("m.bin").alias("bins"), F.xxhash64(common).alias("g"), F.explode(F.array_distinct("m.bin")).alias("bin"))
    sizes = materialize(each.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "token-bins")
    blocks, half = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    placed = each.join(F.broadcast(sizes), "bin").withColumn("block", F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = placed.repartition(int(min(TASKS, max(1, blocks))), "bin", "block")
    packed = materialize(dealt.groupBy("bin", "block").applyInArrow(_packed, "bin long, block int, blocks int, forms binary"), "token-blocks")
    # On a ring of blocks each one meets itself and those up to half the ring on; of opposite blocks one meets the other.
    others = packed.withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("blocks div 2").cast("int")))).withColumn("i", F.pmod(F.col("block") - F.col("step"), F.col("blocks")))
    others = others.filter((F.col("step") > 0) & ((F.col("step") * 2 < F.col("blocks")) | (F.col("i") < F.col("step"))))
    spans = packed.withColumns({"step": F.lit(0), "i": F.col("block"), "span": F.explode(F.sequence(F.lit(0), F.expr(f"blocks div 2 div {SPAN}").cast("int")))})
    sent = spans.unionByName(others.withColumn("span", F.expr(f"step div {SPAN}").cast("int"))).select("bin", "i", "span", "step", "forms")
    tasks = blocks * (1 + half // 2 // SPAN)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own, span = table["bin"][0].as_py(), table["span"][0].as_py()
        steps, sides = table["step"].to_pylist(), table["forms"]
        opened = lambda k: pa.ipc.open_stream(sides[k].as_buffer()).read_all()
        mine = opened(steps.index(0))
        if span == 0:
            yield from _met(mine, None, own, share, edits)
        for k, step in enumerate(steps):
            if step:
                yield from _met(mine, opened(k), own, share, edits)

    kind = dict(forms.dtypes)["name"]
    schema = f"a {kind}, b {kind}, d int, n int" + (", same boolean" if "strict" in carried else "")
    # The number of tasks is given, since little data makes much work here.
    return sent.repartition(int(min(TASKS, max(1, tasks))), "bin", "i", "span").groupBy("bin", "i", "span").applyInArrow(compare, schema)


def _ratio(cutoff: int) -> tuple[Column, Column]:
    """The ratio of a close pair, and whether it is high enough."""
    ratio = F.floor(100.0 * (F.col("n") - F.col("d")) / F.col("n")).cast("int")
    return ratio, ratio >= cutoff


def blocked_pairs(mentions: DataFrame, cutoff: int = CUTOFF, min_token: int = MIN_TOKEN) -> DataFrame:
    """(a, b, ratio): pairs a < b of forms that share a long token and are similar enough, by insertions and deletions of their sorted tokens."""
    forms = mentions.select(F.col("ns").alias("form")).distinct().withColumn("by", token_sort(F.col("form")))
    ratio, enough = _ratio(cutoff)
    return close_pairs(forms, 100 - cutoff, min_token, edits=False).filter(enough).select("a", "b", ratio.alias("ratio"))


def assign_in_order(kinds: np.ndarray, unknown: int, person: int, later: np.ndarray, earlier: np.ndarray, ratio: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each form, in order of importance, the form that founded its cluster.

    ``kinds`` are the types of forms as numbers. Pairs of similar forms are the place of the ``later`` and of the ``earlier``
    one in this order, their ratio, and whether their last tokens are similar. A form joins the cluster with the most similar
    form among those it may join, the one founded first on a tie, or founds its own. It may join a cluster whose type agrees
    or if either is unknown; where either is a person, only through a form with a similar last token.
    """
    order = np.lexsort((earlier, later))
    later, earlier, ratio, same = later[order], earlier[order], ratio[order].astype(np.int64), same[order]
    home = np.arange(len(kinds))
    forms, at = np.unique(later, return_index=True)
    for form, a, b in zip(forms.tolist(), at.tolist(), [*at[1:].tolist(), len(later)]):
        kind, founders = kinds[form], home[earlier[a:b]]
        types = kinds[founders]
        may = (types == kind) | (types == unknown) | (kind == unknown)
        may &= same[a:b] | ~((types == person) | (kind == person))
        if may.any():
            score = ratio[a:b][may] * len(home) - founders[may]
            home[form] = founders[may][score.argmax()]
    return home


def founders(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, founder) for ``forms`` (name, surface, type, freq) that join another one through ``pairs`` (a, b, ratio, same).

    A form can only join a cluster through such a pair, so components of pairs can be assigned apart from each other. Many
    components go to one task with their pairs, all of them where pairs are few; one component isn't divided.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    tasks = 1 + pairs.count() // PAIRS
    if tasks == 1:
        nodes, edges = forms.join(ends, "name").withColumn("task", F.lit(0)), pairs.withColumn("task", F.lit(0))
    else:
        of = materialize(components(spanning(pairs.select("a", "b"))).select(F.col("node").alias("name"), F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task")), "form-tasks")
        nodes, edges = forms.join(of, "name"), pairs.join(of.select(F.col("name").alias("a"), F.col("task").alias("__task")), "a").withColumn("task", F.col("__task"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("freq", "descending"), ("surface", "ascending"), ("type", "ascending")]))
        names = left["name"].to_numpy()
        kinds = left["type"].combine_chunks().dictionary_encode()
        known = kinds.dictionary.to_pylist()
        code = lambda t: known.index(t) if t in known else -2
        by_name = np.argsort(names)
        place = lambda c: by_name[np.searchsorted(names, right[c].to_numpy(), sorter=by_name)]
        u, v = place("a"), place("b")
        home = assign_in_order(kinds.indices.fill_null(-1).to_numpy(), code("unknown"), code("person"), np.maximum(u, v), np.minimum(u, v), right["ratio"].to_numpy(), right["same"].to_numpy())
        joined = np.flatnonzero(home != np.arange(len(home)))
        return pa.table({"name": names[joined], "founder": names[home[joined]]})

    nodes, edges = nodes.select("task", "name", "surface", "type", "freq"), edges.select("task", "a", "b", "ratio", "same")
    return nodes.groupBy("task").cogroup(edges.groupBy("task")).applyInArrow(run, "name long, founder long")


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of ``edges``, two longs, and no more in a partition than it has nodes."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def stars() -> np.ndarray:
            nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            u, v = ends.reshape(2, -1)
            root = np.arange(len(nodes))
            while True:
                low = np.minimum(root[u], root[v])
                old = root.copy()
                for side in (u, v):
                    np.minimum.at(root, side, low)
                    np.minimum.at(root, old[side], low)
                while (root != root[root]).any():
                    root = root[root]
                if (root == old).all():
                    break
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return np.array([nodes[moved], nodes[root[moved]]])

        for batch in batches:
            held.append(np.array([c.to_numpy() for c in batch.columns]))
            count += len(batch)
            if count >= PAIRS:
                held = [stars()]
                count = held[0].shape[1]
        if held:
            u, v = stars()
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return edges.mapInArrow(forest, "u long, v long")


def resolve(mentions: DataFrame, known: DataFrame | None = None, cutoff: int = CUTOFF, min_token: int = MIN_TOKEN, strip_roles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(surface, type, freq) to assignments (surface, node_id) and nodes (node_id, canonical, type, aliases, n).

    Similar forms that share a long token are paired and scored once, over all forms. Forms are assigned in order of their
    most frequent surface, by text on a tie, and have its type; other surfaces of a form go with it. ``known``
    (form, canonical) gives canonical names.
    """
    rows = materialize(prepared(mentions, strip_roles).select("surface", "type", F.col("freq").cast("long").alias("freq"), "ns"), "surfaces")
    first = F.min_by(F.struct("surface", "type", "freq"), F.struct(F.col("freq").isNull(), -F.col("freq"), "surface", F.col("type").isNull(), "type"))
    heads = rows.groupBy("ns").agg(first.alias("h")).select(F.monotonically_increasing_id().alias("name"), F.col("ns").alias("form"), "h.surface", "h.type", "h.freq")
    forms = materialize(heads, "forms")
    sized = forms.select("name", "form", token_sort(F.col("form")).alias("by"), F.coalesce(last_token(F.col("form")), F.lit("")).alias("last"), F.coalesce(F.col("type") == "person", F.lit(False)).alias("strict"))
    ratio, enough = _ratio(cutoff)
    pairs = materialize(close_pairs(sized, 100 - cutoff, min_token, edits=False).filter(enough).select("a", "b", ratio.cast("short").alias("ratio"), "same"), "similar-forms")
    homes = founders(forms, pairs)
    head = forms.select(F.col("name").alias("founder"), F.col("surface").alias("head"), F.col("type").alias("head_type"), F.col("freq").alias("head_freq"), F.col("form").alias("head_ns"))
    founded = forms.select("name", F.col("form").alias("ns")).join(homes, "name", "left").withColumn("founder", F.coalesce("founder", "name")).join(head, "founder").drop("name", "founder")
    done = materialize(rows.join(founded, "ns"), "resolved")
    heads = done.groupBy("head_ns").agg(F.first("head").alias("head"), F.first("head_type").alias("head_type"), F.first("head_freq").alias("head_freq"), F.sort_array(F.collect_set("surface")).alias("aliases"), F.sum("freq").alias("n"), F.sort_array(F.collect_list(F.struct(-F.col("freq"), F.col("surface"), F.col("ns")))).alias("members"))
    nodes = numbered(heads.withColumn("__order", -F.col("head_freq")), "idx", "__order", "head", "head_type").withColumn("node_id", F.format_string("N%05d", "idx"))
    if known is None:
        canonical = nodes.withColumn("canonical", F.col("head"))
    else:
        # The first member, in order of assignment, whose form is known names the node.
        named = nodes.select("node_id", F.posexplode("members").alias("pos", "m")).join(known.select(F.col("form").alias("f"), F.col("canonical").alias("k")), F.col("m.ns") == F.col("f")).groupBy("node_id").agg(F.min_by("k", "pos").alias("k"))
        canonical = nodes.join(named, "node_id", "left").withColumn("canonical", F.coalesce("k", "head"))
    assign = done.join(nodes.select("head_ns", "node_id"), "head_ns").select("surface", "node_id")
    return assign, canonical.select("node_id", "canonical", F.col("head_type").alias("type"), "aliases", "n")


def surface_freq(relations: DataFrame) -> DataFrame:
    """(surface, freq) over both ends of relations."""
    return relations.select(F.explode(F.array("from_entity", "to_entity")).alias("surface")).filter("surface IS NOT NULL").groupBy("surface").agg(F.count(F.lit(1)).alias("freq"))


def collapse(assign: DataFrame) -> DataFrame:
    """One row (surfaces, nodes, ratio)."""
    return assign.agg(F.countDistinct("surface").alias("surfaces"), F.countDistinct("node_id").alias("nodes")).withColumn("ratio", F.col("surfaces") / F.greatest("nodes", F.lit(1)))


def most_collapsed(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The nodes of most mentions among those with several aliases."""
    return nodes.filter(F.size("aliases") > 1).orderBy(F.desc("n"), "node_id").limit(k)


def alias_table(nodes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(node_id, surface_form, surface_norm, n_occurrences): one node per normalised form, the smallest id; counts from mentions (text) where given."""
    rows = nodes.select("node_id", F.explode("aliases").alias("surface_form")).withColumn("surface_norm", normalize(F.col("surface_form"))).filter("surface_norm <> ''")
    if mentions is not None:
        n = mentions.groupBy(F.col("text").alias("surface_form")).agg(F.count(F.lit(1)).cast("int").alias("n_occurrences"))
        rows = rows.join(n, "surface_form", "left").withColumn("n_occurrences", F.coalesce("n_occurrences", F.lit(0)))
    else:
        rows = rows.withColumn("n_occurrences", F.lit(0))
    first = Window.partitionBy("surface_norm").orderBy("node_id", "surface_form")
    return rows.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").select("node_id", "surface_form", "surface_norm", "n_occurrences")
