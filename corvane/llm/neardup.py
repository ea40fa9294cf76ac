"""MinHash near-duplicate grouping with SuperMinHash signatures.

1. Signatures (Arrow, numpy): every element draws a random permutation of the slots rank by
   rank; slot k keeps the smallest rank + fraction that any element gives it. The ranks of one
   element are a permutation, hence correlated over slots, which lowers the variance; a document
   stops as soon as every slot holds a value below the next rank.
2. Documents with equal shingle sets form one class; only a class's smallest id goes on.
3. Banding: slots are cut into bands, a band's hash is a bucket.
4. Verification on full shingle sets. Each bucket compares its members with one pivot. A group in
   which members are left in different components goes on relative to its majority set (below):
   all are compared with its hub, those outside the hub's component with a hub of their own, and
   what is still apart only where two members deviate from the majority in the same shingles. No
   group is gathered and no link between different components is skipped.
5. Union-find grouping of the verified links (components.py).

Majority set: for any set M let L(X) = M - X, A(X) = X - M and d(X) = L(X) + A(X). Then
|X & Y| = |M| - |L(X)| - |L(Y)| + |d(X) & d(Y)|, so that J(X, Y) >= q/100 is the same as
(100 + q) |d(X) & d(Y)| >= w(X) + w(Y) - (100 - q) |M|, with w(X) = 100 |L(X)| + q |A(X)|. Let H be the
member of least w. A member Y that is not linked with H has w(Y) + w(H) > (100 - q) |M|, so whoever
links with Y, X, has (100 + q) |d(X) & d(Y)| > w(X) - w(H): about half of X's deviations are Y's too.
Members that deviate by edits of their own are thus left out without being paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U64, distinct, mix, shingles, spans, text_buffers, words
from .components import connected_components
from .scratch import materialize, row_keys

BANDS = 32
ROWS = 4
#: At most so many candidate ids (8 bytes each) are broadcast to pick texts; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
_EMPTY = U64(1 << 62)
_LOW = U64(0xFFFFFFFF)


def superminhash(h: np.ndarray, rows: np.ndarray, n: int, slots: int) -> np.ndarray:
    """(n, slots) signatures of the elements h, whose documents `rows` ascend.

    A value is rank << 32 | fraction; rows without elements keep the empty value.
    """
    out = np.full(n * slots, _EMPTY, U64)
    if not len(h):
        return out.reshape(n, slots)
    act = np.arange(len(h))
    perm: np.ndarray | None = None
    width = np.uint8 if slots <= 256 else np.uint16
    for rank in range(slots):
        e, d = h[act], rows[act]
        draw = mix(e + U64((0xA0761D6478BD642F * (rank + 1)) & ((1 << 64) - 1)))
        pick = (rank + (((draw >> U64(32)) * U64(slots - rank)) >> U64(32)).astype(np.int64)) if rank else ((draw >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64)
        if perm is None:
            slot = pick
        else:
            line = np.arange(len(act))
            slot = perm[line, pick].astype(np.int64)
            perm[line, pick] = perm[:, rank]
        np.minimum.at(out, d * slots + slot, (U64(rank) << U64(32)) | (draw & _LOW))
        worst = out.reshape(n, slots).max(axis=1)
        alive = (worst >= U64(rank + 1) << U64(32))[d]
        if not alive.any():
            break
        if perm is None:
            act, pick = act[alive], pick[alive]
            perm = np.broadcast_to(np.arange(slots, dtype=width), (len(act), slots)).copy()
            perm[np.arange(len(act)), pick] = 0
        elif alive.sum() < 0.8 * len(act):
            act, perm = act[alive], perm[alive]
    return out.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket hashes as signed 64-bit numbers."""
    part = signature[:, : bands * rows].reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15), part.shape[:2]).copy()
    for j in range(rows):
        key = mix(key + part[:, :, j] * U64(2 * j + 0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _signer(size: int, bands: int, rows: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in spans(offsets):
                w = words(data, offsets[i : j + 1])
                h, doc, _ = shingles(w, size)
                h, counts = distinct(h, doc, j - i)
                doc = np.repeat(np.arange(j - i), counts)
                keys = band_keys(superminhash(h, doc, j - i, bands * rows), bands, rows)
                edge = np.concatenate([[0], np.cumsum(counts)])
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                    total = np.concatenate([[U64(0)], np.cumsum(mix(h * U64(salt)))])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                flat = pa.array(keys.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["id", "n", "set_a", "set_b", "bands"])

    return sign


def _verifier(size: int, percent: int) -> Callable:
    """Exact overlap of the sets of two texts per row; `rest`: hashes of x outside p, `miss`: of p outside x, which the steps above need of linked members as well."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_data, p_at = text_buffers(batch.column(2))
            x_data, x_at = text_buffers(batch.column(3))
            for i, j in spans(p_at + x_at):
                sets = []
                for data, at in ((p_data, p_at), (x_data, x_at)):
                    h, doc, _ = shingles(words(data, at[i : j + 1]), size)
                    h, counts = distinct(h, doc, j - i)
                    sets.append((h, np.concatenate([[0], np.cumsum(counts)])))
                (hp, ep), (hx, ex) = sets
                common = np.zeros(j - i, np.int64)
                rest: list[np.ndarray] = []
                miss: list[np.ndarray] = []
                for k in range(j - i):
                    a, b = hp[ep[k] : ep[k + 1]], hx[ex[k] : ex[k + 1]]
                    spot = np.searchsorted(a, b)
                    hit = a[np.minimum(spot, len(a) - 1)] == b if len(a) else np.zeros(len(b), bool)
                    common[k] = hit.sum()
                    rest.append(b[~hit])
                    gone = np.ones(len(a), bool)
                    gone[spot[hit]] = False
                    miss.append(a[gone])
                np_, nx = np.diff(ep), np.diff(ex)
                linked = 100 * common >= percent * (np_ + nx - common)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in part])]).astype(np.int32)), pa.array(np.concatenate(part).view(np.int64))) for part in (rest, miss)]
                head = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(v) for v in (np_, nx, common, linked)), *lists], ["p", "x", "np", "nx", "common", "linked", "rest", "miss"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """pairs (p, x) with both texts' exact overlap."""
    ids = materialize(pairs.select(F.explode(F.array("p", "x")).alias("id")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    some = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    joined = pairs.join(some.withColumnsRenamed({"id": "p", "text": "p_text"}), "p").join(some.withColumnsRenamed({"id": "x", "text": "x_text"}), "x")
    out = joined.select("p", "x", "p_text", "x_text").mapInArrow(_verifier(size, percent), "p long, x long, np long, nx long, common long, linked boolean, rest array<long>, miss array<long>")
    return materialize(out, name)


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (p, x, ...) with the present component c of x."""
    return members.join(comps.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): documents linked at Jaccard >= percent/100 form components.

    Every row of docs gives a row. Null texts count as empty; empty texts have no shingles and link
    with nothing; a text of fewer words than a shingle is one shingle. component_id is the smallest
    id in the component, and kept marks the row that holds it. Where ids repeat or are null, rows are
    documents of their own: just one row of a component is kept, of several with the smallest id any
    one, and a component without ids has a null component_id. Only id_col and text_col are read, so
    extra columns cannot clash. A pair at exactly 0.8 shares no band with probability
    (1 - 0.8**4)**32 < 5e-8.
    """
    rows, key = row_keys(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    out = row_groups(rows, key, "id", "text", shingle_words, percent, bands, rows_per_band)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def row_groups(rows: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """near_duplicates of rows with a key from row_keys, which the result keeps as `key`."""
    found = _components(rows.select(F.col(key).alias("id"), F.col(text_col).alias("text")), shingle_words, percent, bands, rows_per_band)
    if key == id_col:
        return found.select(F.col("id").alias("key"), "id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    named = materialize(found.withColumnRenamed("id", "key").join(rows.select(F.col(key).alias("key"), F.col(id_col).alias("id")), "key"), "grouped")
    # the smallest id first, null last
    least = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    joined = named.join(least, "component")
    return joined.select("key", "id", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("kept"))


def _components(texts: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, n, component) of texts (id, text) with unique ids: set size and smallest id of the component."""
    signed = materialize(texts.mapInArrow(_signer(shingle_words, bands, rows), "id long, n long, set_a long, set_b long, bands array<long>"), "signed")
    full = signed.filter("n > 0")
    classes = materialize(full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    entries = classes.select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("p"), F.count("*").alias("k")).filter("k > 1").select("key", "p")
    stars = materialize(entries.join(shared, "key").filter("rep <> p").select("p", F.col("rep").alias("x")).distinct(), "stars")
    checked = _verified(stars, texts, shingle_words, percent, "checked")

    links = checked.filter("linked").select(F.col("p").alias("u"), F.col("x").alias("v"))
    comps = materialize(connected_components(links), "comps")
    extra = _open_links(checked, comps, percent)
    if extra is not None:
        links = links.union(extra)
        comps = materialize(connected_components(links), "comps")

    of_class = classes.select("set_a", "set_b", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = full.select("id", "n", "set_a", "set_b").join(of_class, ["set_a", "set_b"]).select("id", "n", "component")
    return out.union(signed.filter("n = 0").select("id", "n", F.col("id").alias("component")))


def _centred(members: DataFrame, percent: int) -> DataFrame:
    """members (p, x, np, rest, miss, ...) with diff, weight and room relative to their group's majority set, and the group's hub.

    The majority set M differs from p's set by the shingles that more than half of the members change.
    diff lists the shingles in just one of x's set and M, weight is 100 |M - x| + percent |x - M|, room is
    (100 - percent) |M|; the hub is the member of least weight, ties by id. Links are then decided by
    `_shared` (see the module's text).
    """
    mark = lambda col, extra: F.transform(col, lambda h: F.struct(h.alias("h"), F.lit(extra).alias("extra")))
    marks = members.select("p", F.inline(F.concat(mark("rest", True), mark("miss", False))))
    sizes = members.groupBy("p").agg(F.count("*").alias("of"))
    usual = marks.groupBy("p", "h", "extra").agg(F.count("*").alias("k")).join(sizes, "p").filter("2 * k > of")
    usual = usual.groupBy("p").agg(F.collect_list(F.expr("if(extra, h, null)")).alias("more"), F.collect_list(F.expr("if(extra, null, h)")).alias("less"))
    none = F.array().cast("array<long>")
    rows = members.join(usual, "p", "left").withColumns({"more": F.coalesce("more", none), "less": F.coalesce("less", none)})
    rows = rows.withColumn("lacks", F.concat(F.array_except("miss", "less"), F.array_except("more", "rest"))).withColumn("adds", F.concat(F.array_except("rest", "more"), F.array_except("less", "miss")))
    rows = rows.select("p", "x", "c", "ps", F.concat("lacks", "adds").alias("diff"), (100 * F.size("lacks") + percent * F.size("adds")).alias("weight"), ((100 - percent) * (F.col("np") - F.size("less") + F.size("more"))).alias("room"))
    rows = materialize(rows, "centred")
    return rows.join(rows.groupBy("p").agg(F.min(F.struct("weight", "x", "diff")).alias("hub")), "p")


def _shared(a: str, b: str, percent: int) -> Column:
    """Whether the members a and b (structs or aliases) of one group are linked."""
    return (100 + percent) * F.size(F.array_intersect(f"{a}diff", f"{b}diff")) >= F.col(f"{a}weight") + F.col(f"{b}weight") - F.col(f"{a}room")


def _open_links(checked: DataFrame, comps: DataFrame, percent: int) -> DataFrame | None:
    """Links (u, v) between members of a pivot's group that lie in different components so far."""
    groups = _labelled(checked.select("p", "x", "np", "nx", "common", "rest", "miss"), comps)
    head = _labelled(checked.select("p").distinct().select("p", F.col("p").alias("x")), comps)
    # a group is open if a member that is not in the pivot's component could still link to another member;
    # the groups are summed up before they meet their pivots, so that a large one stays in many tasks
    spread = groups.groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).filter("k > 1")
    open_groups = spread.join(head.select("p", F.col("c").alias("pc")), "p").filter("low <> pc or high <> pc").select("p")
    open_groups = materialize(open_groups, "open")
    if open_groups.isEmpty():
        return None
    groups = materialize(groups.join(open_groups, "p"), "groups")
    shared = groups.select("p", F.explode("rest").alias("h")).groupBy("p", "h").agg(F.count("*").alias("k")).filter("k > 1").select("p", "h")
    also = groups.select("p", "x", F.explode("rest").alias("h")).join(shared, ["p", "h"]).groupBy("p", "x").agg(F.count("*").alias("r"))
    # a pair that shares several groups is made in the first of them only; what one group proves holds for it
    all_of_x = groups.groupBy("x").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    # x shares at most common + r shingles with any other member, and a link needs percent of x's
    able = groups.join(also, ["p", "x"], "left").filter(100 * (F.col("common") + F.coalesce("r", F.lit(0))) >= percent * F.col("nx")).join(all_of_x, "x")
    able = materialize(able.select("p", "x", "np", "rest", "miss", "c", "ps"), "able")

    links: DataFrame | None = None
    part, centred = _crowded(able), None
    for _ in range(2):  # hubs of whole groups, then of those outside the hub's component
        rows = _centred(part, percent)
        centred = rows if centred is None else centred
        star = materialize(rows.filter("x <> hub.x").filter(_shared("", "hub.", percent)).select(F.col("hub.x").alias("u"), F.col("x").alias("v")), "star")
        links = star if links is None else links.union(star)
        merged = materialize(connected_components(able.select(F.col("c").alias("u"), F.col("x").alias("v")).distinct().union(links)), "merged")
        hubs = _labelled(centred.select("p", F.col("hub.x").alias("x")).distinct(), merged).select("p", F.col("c").alias("hub_c"))
        part = _crowded(_labelled(part.drop("c"), merged).join(hubs, "p").filter("c <> hub_c").drop("hub_c"))

    rows = _labelled(centred.drop("c"), merged).join(hubs, "p").withColumn("out", F.expr("c <> hub_c"))
    some_out = rows.groupBy("p").agg(F.max("out").alias("any")).filter("any").select("p")
    # the hub is compared with all
    rows = materialize(rows.filter("x <> hub.x").join(some_out, "p").withColumn("least", F.col("hub.weight")).drop("hub", "hub_c"), "rows")
    keyed = _keyed(rows, percent)
    a, b = keyed.filter("out").alias("a"), keyed.filter("strong").alias("b")
    near = F.expr("a.p = b.p and a.h = b.h and a.c <> b.c and a.weight <= b.reach and b.weight <= a.reach and (not b.out or a.strong and a.x < b.x)")
    pairs = a.join(b, near & (F.array_min(F.array_intersect("a.ps", "b.ps")) == F.col("a.p"))).select("a.p", F.col("a.x").alias("u"), F.col("b.x").alias("v")).distinct()
    sets = rows.select("p", F.col("x"), F.struct("diff", "weight", "room").alias("s"))
    both = materialize(pairs, "pairs").join(sets.withColumnsRenamed({"x": "u", "s": "i"}), ["p", "u"]).join(sets.withColumnsRenamed({"x": "v", "s": "j"}), ["p", "v"])
    return links.union(materialize(both.filter(_shared("i.", "j.", percent)).select("u", "v"), "found"))


def _crowded(members: DataFrame) -> DataFrame:
    """The members of groups p in which more than one component is left."""
    crowd = members.groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("p")
    return materialize(members.join(crowd, "p", "left_semi"), "crowd")


def _keyed(rows: DataFrame, percent: int) -> DataFrame:
    """rows without diff, one for each shingle h of it by which a linked member of another component is found.

    Members that share k shingles of their diffs are found by one of the first size - k + 1 of each in
    any common order: unshared ones, then the rarest. For every partner y, (100 + percent) * k >= weight +
    weight(y) - room, where weight(y) is at least both the group's least and percent * k. One of a pair
    of different components is outside the hub's one; the other (strong) shares (100 + percent) * k >
    weight - least. reach: the greatest weight of a partner that shares no shingle before h.
    """
    each = rows.select("p", "x", "c", F.explode("diff").alias("h"))
    often = each.groupBy("p", "h").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("p", "h", "k")
    ranked = each.drop("c").join(often, ["p", "h"]).groupBy("p", "x").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("l"))
    n, q, w, least, room = F.size("l"), 100 + percent, F.col("weight"), F.col("least"), F.col("room")
    share = F.greatest(F.lit(1), F.ceil((w + least - room) / q), F.ceil((w - room) / 100))
    wide = rows.join(ranked, ["p", "x"]).select("p", "x", "c", "ps", "weight", "out", "room", n.alias("n"), share.alias("share"), F.ceil((w - least + 1) / q).alias("more"), F.posexplode("l").alias("i", "e"))
    left = F.col("n") - F.col("i")
    wide = wide.filter(left >= F.col("share")).withColumn("strong", left >= F.col("more")).filter("out or strong")
    return materialize(wide.select("p", "x", "c", "ps", "weight", "out", (q * left - w + room).alias("reach"), "strong", F.col("e.h").alias("h")), "keyed")
