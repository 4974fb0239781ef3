"""Which block belongs to which: captions and footnotes to bodies, texts to lists, and reading order.

All joins are keyed by page, so a page's blocks meet in one task and nothing else does. Ties always
have a rule: the lowest position of those that are equally near.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, center_distance, contains, overlap_area
from ..schema import CLASS_ORDER
from .pages import on_pages

_BOX = ["x0", "y0", "x1", "y1"]


def _side(df: DataFrame, prefix: str, *cols: str) -> DataFrame:
    return df.select("page_id", *(F.col(c).alias(prefix + c) for c in cols))


def without_contained(df: DataFrame) -> DataFrame:
    """Blocks that lie in no other block of their page; equal boxes contain each other, so both go."""
    a, b = df.alias("a"), _side(df, "o_", "idx", *_BOX).alias("b")
    inside = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("idx") != F.col("o_idx")) & contains(box("o_"), box())
    return a.join(b, inside, "left_anti")


def attach_nearest(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(page_id, obj_idx, sub_idx): each object's subject of the least distance in order, then of
    centres, then of the lowest position. Objects on pages without a subject have none."""
    s, o = _side(subjects, "s_", "idx", *_BOX), _side(objects, "o_", "idx", *_BOX)
    rank = Window.partitionBy("page_id", "o_idx").orderBy(F.abs(F.col("o_idx") - F.col("s_idx")), F.round(center_distance(box("o_"), box("s_")), 9), "s_idx")
    near = o.join(s, "page_id").withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return near.select("page_id", F.col("o_idx").alias("obj_idx"), F.col("s_idx").alias("sub_idx"))


def attach(df: DataFrame, kind: str, part: str) -> DataFrame:
    """Captions or footnotes (`part`) with their bodies: contained boxes go on either side first."""
    bodies = without_contained(df.where(F.col("type") == kind))
    return attach_nearest(bodies, without_contained(df.where(F.col("type") == f"{kind}_{part}")))


def reassign_footnotes(attached: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, obj_idx, sub_idx) with footnotes before their body moved to the nearest body before
    them; sub_idx is null if there is none, and the footnote becomes text."""
    b = bodies.select("page_id", F.col("idx").alias("b_idx"))
    early = attached.where("obj_idx < sub_idx")
    earlier = (F.col("e.page_id") == F.col("b.page_id")) & (F.col("b_idx") <= F.col("obj_idx")) & (F.col("b_idx") != F.col("sub_idx"))
    moved = early.alias("e").join(b.alias("b"), earlier, "left").groupBy("e.page_id", "obj_idx").agg(F.max("b_idx").alias("sub_idx"))
    return attached.where("obj_idx > sub_idx").unionByName(moved)


def contiguous(members: DataFrame, down: bool) -> DataFrame:
    """(page_id, sub_idx, idx, kept): captions (down) count from the highest index in a run without
    gaps, but for one that is just the body; footnotes from the lowest, without exception."""
    w = Window.partitionBy("page_id", "sub_idx").orderBy(F.desc("idx") if down else F.asc("idx"))
    before = F.lag("idx").over(w)
    gap = (before - F.col("idx") if down else F.col("idx") - before)
    broken = F.coalesce((gap != 1) & ~((gap == 2) & (F.col("sub_idx") == F.col("idx") + 1)) if down else gap != 1, F.lit(False))
    marked = members.withColumn("broken", broken.cast("int"))
    return marked.withColumn("kept", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("broken")


def list_members(df: DataFrame) -> DataFrame:
    """(page_id, idx, type, list_idx): texts of which a list covers at least 0.8; the first list counts."""
    t, s = _side(df.where(F.col("type").isin("text", "ref_text")), "t_", "idx", "type", *_BOX), _side(df.where("type = 'list'"), "s_", "idx", *_BOX)
    own = (F.col("t_x1") - F.col("t_x0")) * (F.col("t_y1") - F.col("t_y0"))
    met = t.join(s, "page_id").where((own > 0) & (10 * overlap_area(box("t_"), box("s_")) >= 8 * own))
    return met.groupBy("page_id", F.col("t_idx").alias("idx"), F.col("t_type").alias("type")).agg(F.min("s_idx").alias("list_idx"))


def list_subtypes(members: DataFrame) -> DataFrame:
    """(page_id, list_idx, sub_type): the most frequent type of a list's texts, of equal ones the
    type that is listed first, and texts are listed before references."""
    n = members.groupBy("page_id", "list_idx", "type").agg(F.count("*").alias("n"))
    return n.groupBy("page_id", "list_idx").agg(F.max_by("type", F.struct("n", F.when(F.col("type") == "text", 1).otherwise(0))).alias("sub_type"))


def orphans_to_text(df: DataFrame, attached: DataFrame, kinds: list[str]) -> DataFrame:
    """All blocks, with members of these types that are attached to nothing as plain text."""
    loose = df.where(F.col("type").isin(kinds)).join(attached.select("page_id", F.col("obj_idx").alias("idx")), ["page_id", "idx"], "left_anti").withColumn("type", F.lit("text"))
    rest = df.where(~F.col("type").isin(kinds)).unionByName(df.where(F.col("type").isin(kinds)).join(attached.select("page_id", F.col("obj_idx").alias("idx")), ["page_id", "idx"], "left_semi"))
    return rest.unionByName(loose)


def page_class(kind):
    """Position of a block's class on its page."""
    c = F.when(kind.isin("image", "table", "code", "ref_text", "phonetic", "title", "text", "list", "seal", "char"), kind).when(kind == "equation", "interline_equation").when(kind == "algorithm", "code").otherwise("discarded")
    return F.array_position(F.array(*map(F.lit, CLASS_ORDER)), c)


def reading_order(df: DataFrame) -> DataFrame:
    """Blocks with `order` from 0 on: by index, then by class."""
    w = Window.partitionBy("page_id").orderBy("idx", page_class(F.col("type")))
    return df.withColumn("order", (F.row_number().over(w) - 1).cast("int"))


def family_parts(df: DataFrame, kind: str, beside: bool = True) -> DataFrame:
    """(page_id, sub_idx, idx, part): the parts of each body, itself included. beside: footnotes stand
    behind their body, and only runs without gaps count; else captions are taken as they are."""
    bodies = without_contained(df.where(F.col("type") == kind))
    own = bodies.select("page_id", F.col("idx").alias("sub_idx"), "idx", F.lit("body").alias("part"))
    caps = attach(df, kind, "caption").withColumnRenamed("obj_idx", "idx")
    notes = attach(df, kind, "footnote")
    if beside:
        caps = contiguous(caps, True).where("kept")
        notes = reassign_footnotes(notes, bodies).where("sub_idx is not null")
    notes = notes.withColumnRenamed("obj_idx", "idx")
    if beside:
        notes = contiguous(notes, False).where("kept")
    for rows, part in ((caps, "caption"), (notes, "footnote")):
        own = own.unionByName(rows.select("page_id", "sub_idx", "idx", F.lit(part).alias("part")))
    return own


def two_layer(df: DataFrame, kind: str) -> DataFrame:
    """(page_id, sub_idx, captions, footnotes, children): each body with its parts in order. Blocks
    are dealt out by page once, and all joins reuse that."""
    all_ = family_parts(df.repartition("page_id"), kind)
    count = lambda p: F.sum((F.col("part") == p).cast("int")).alias(f"{p}s")
    return all_.groupBy("page_id", "sub_idx").agg(count("caption"), count("footnote"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["part"])), ",").alias("children"))


def nested_tables(df: DataFrame) -> DataFrame:
    """Tables that hold three others and more, none of which meets another, with more than 0.8 of
    the table's area in sum; only on pages with three tables and more."""
    t = df.where("type = 'table'")
    many = t.groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 3").select("page_id")
    t = t.join(many, "page_id", "left_semi")
    a, b = _side(t, "a_", "idx", *_BOX), _side(t, "b_", "idx", *_BOX)
    size = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    held = a.join(b, "page_id").where((F.col("a_idx") != F.col("b_idx")) & (10 * overlap_area(box("a_"), box("b_")) >= 8 * size("b_")))
    pairs = held.alias("x").join(held.select("page_id", "a_idx", *(F.col(f"b_{c}").alias(f"c_{c}") for c in ("idx", *_BOX))).alias("y"), ["page_id", "a_idx"]).where("b_idx < c_idx")
    meeting = pairs.where(overlap_area(box("b_"), box("c_")) > 0).select("page_id", "a_idx").distinct()
    full = held.groupBy("page_id", "a_idx").agg(F.count("*").alias("n"), F.sum(size("b_")).alias("inner"), F.first(size("a_")).alias("own")).where("n >= 3 and 10 * inner > 8 * own")
    return full.join(meeting, ["page_id", "a_idx"], "left_anti").select("page_id", F.col("a_idx").alias("idx"))


def match_greedily(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(page_id, sub_idx, obj_idx): boxes paired by gap, from the upper left on.

    The free item next to the free items' upper left corner meets the nearest free one of the other
    kind. If some subject is at most a third as far from the object (a gap of 0 always is), the
    subject steps back instead. Objects that stay free go to the nearest subject; subjects without
    an object have null. One step depends on all before it, so a page is worked on as a whole.
    """
    cols = ["page_id", "idx", *_BOX]
    both = subjects.select(*cols, F.lit(True).alias("subject")).unionByName(objects.select(*cols, F.lit(False).alias("subject")))

    def page(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (not r["subject"], r["x0"] ** 2 + r["y0"] ** 2))  # subjects first
        n = sum(r["subject"] for r in rows)
        box = np.array([[r[c] for c in _BOX] for r in rows], float)
        over = lambda lo, hi: np.maximum(np.maximum(box[None, :, lo] - box[:, None, hi], box[:, None, lo] - box[None, :, hi]), 0)
        gap = np.hypot(over(0, 2), over(1, 3))
        free = np.ones(len(rows), bool)
        pairs: list[tuple[int, int]] = []
        while len(pairs) < n and free.any():
            at = np.flatnonzero(free)
            corner = box[at, :2].min(axis=0)
            at = at[np.argsort(((box[at, :2] - corner) ** 2).sum(axis=1), kind="stable")]
            first = at[0]
            others = at[(at < n) != (first < n)]
            if not len(others):
                break
            second = others[gap[first, others].argmin()]
            sub, obj = (first, second) if first < n else (second, first)
            free[sub] = False
            if gap[sub, obj] < 3 * gap[:n, obj].min():
                free[obj] = False
                pairs.append((int(sub), int(obj)))
        if n:
            pairs += [(int(gap[:n, k].argmin()), int(k)) for k in np.flatnonzero(free) if k >= n]
        key, alone = rows[0]["page_id"], sorted(set(range(n)) - {x for x, _ in pairs})
        return [(key, rows[x]["idx"], rows[y]["idx"]) for x, y in pairs] + [(key, rows[x]["idx"], None) for x in alone]

    return on_pages(both, page, "page_id long, sub_idx int, obj_idx int", ["idx"])
