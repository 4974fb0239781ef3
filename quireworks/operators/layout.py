"""Layout text to typed blocks, filters of blocks, and requests for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.geometry import bounds
from ..functions.text import once, strip
from ..schema import ANGLES, BLOCK_TYPES, FREQUENCY_PENALTY, NOT_EXTRACTED, PARATEXT, PROMPTS, SAMPLING

_LINE = r"^<box:([0-9 ]+)><label:(\w+)>(<[^\n]*>)?$"


def angle_of(tail: Column) -> Column:
    """The first of the direction words that occurs anywhere; null without one."""
    c = None
    for word, angle in ANGLES.items():
        c = F.when(tail.contains(word), angle) if c is None else c.when(tail.contains(word), angle)
    return c.cast("int")


def normalised(points: Column) -> Column:
    """Whole numbers of 0 to 1000 to shares of the page; what lies on the far edge and isn't the
    near edge too becomes 0.999 at most."""

    def clamp(v: Column, i: Column) -> Column:
        same = F.filter(points, lambda w, j: j % 2 == i % 2)
        return once(same, lambda s: F.when((v == F.array_max(s)) & (v != F.array_min(s)), F.least(v, F.lit(999))).otherwise(v) / 1000.0)

    return F.transform(points, clamp)


def blocks_of(text: Column, rectangles: bool = False) -> Column:
    """The blocks of layout text, an array of (idx, type, bbox, angle): one for each line that is a block.

    Lines of another form, of unknown type, with fewer than four, an odd number of or too large
    numbers are left out; an unknown angle is null. idx counts the lines that stay.
    rectangles: polygons become the rectangles around them.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(_LINE))
    parts = F.transform(lines, lambda x: F.struct(
        F.lower(F.regexp_extract(x, _LINE, 2)).alias("type"), angle_of(F.regexp_extract(x, _LINE, 3)).alias("angle"),
        F.transform(F.filter(F.split(F.regexp_extract(x, _LINE, 1), " +"), lambda w: w != ""), lambda w: w.try_cast("int")).alias("points"),
    ))

    def good(x: Column) -> Column:
        p = x["points"]
        return x["type"].isin(BLOCK_TYPES) & (F.size(p) >= 4) & (F.size(p) % 2 == 0) & F.forall(p, lambda v: v.isNotNull() & (v >= 0) & (v <= 1000))

    def made(x: Column, i: Column) -> Column:
        box = normalised(x["points"])
        return F.struct(i.alias("idx"), x["type"].alias("type"), (once(box, bounds) if rectangles else box).alias("bbox"), x["angle"].alias("angle"))

    return F.transform(F.filter(parts, good), made)


def parse_layout(df: DataFrame, text: str = "output", key: str = "page_id", rectangles: bool = False) -> DataFrame:
    """(key, idx, type, bbox, angle): a row for each block of layout text. Lines are dropped inside the row's
    array, so that those that stay are numbered without a shuffle."""
    return df.select(key, F.inline(blocks_of(F.col(text), rectangles)))


def to_extract(df: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Blocks that go to the recogniser; a filter of its own so that it stays below any UDF."""
    return df.where(~F.col("type").isin([*NOT_EXTRACTED, *(skip or [])]))


def kept_blocks(df: DataFrame, lists: bool = True, paratext: bool = True) -> DataFrame:
    drop = ["equation_block", *([] if lists else ["list"]), *([] if paratext else PARATEXT)]
    return df.where(~F.col("type").isin(drop))


def invalid_blocks(df: DataFrame) -> DataFrame:
    """Rows that break the vocabulary: a quarantine instead of a failed job."""
    return df.where(~F.coalesce(F.col("type").isin(BLOCK_TYPES), F.lit(False)) | (F.col("angle").isNotNull() & ~F.col("angle").isin(0, 90, 180, 270)))


def requests(df: DataFrame, prompts: dict[str, str] | None = None) -> DataFrame:
    """Blocks with their prompts and settings, the default's where a type has none of its own. The
    table of prompts has a row for each type and is sent to the blocks."""
    prompts = prompts or PROMPTS
    rows = [(k, p, FREQUENCY_PENALTY.get(k, 0.0), 1.0 if k in FREQUENCY_PENALTY else 0.0) for k, p in prompts.items()]
    dim = df.sparkSession.createDataFrame(rows, "type string, own_prompt string, own_frequency double, own_presence double")
    default = F.lit(prompts["default"])
    out = df.join(F.broadcast(dim), "type", "left")
    return out.select(
        *df.columns, F.coalesce("own_prompt", default).alias("prompt"),
        F.coalesce("own_frequency", F.lit(FREQUENCY_PENALTY["default"])).alias("frequency_penalty"),
        F.coalesce("own_presence", F.lit(1.0)).alias("presence_penalty"),
        *(F.lit(v).alias(k) for k, v in SAMPLING.items()),
    )


def project_pages(pages: DataFrame, wanted: DataFrame, key: str = "doc_id", page: str = "page_idx") -> DataFrame:
    """Pages by lists of page numbers (key, page_ids): in the lists' order, repeated as often as they
    ask, unknown numbers left out; documents without a list keep all pages."""
    asked = wanted.where(F.size("page_ids") > 0).select(key, F.posexplode("page_ids").alias("position", page))
    some = pages.join(asked, [key, page])
    rest = pages.join(asked.select(key).distinct(), key, "left_anti").withColumn("position", F.col(page))
    return some.unionByName(rest)


def last_page(end: Column, n: Column) -> Column:
    return F.least(F.coalesce(F.when(end >= 0, end), n - 1), n - 1)


def crops(blocks: DataFrame, pages: DataFrame, most_pixels: int = 64_000_000) -> DataFrame:
    """(page_id, idx, crop, size): what is cut out of the page's picture for each block (page_id, idx,
    type, bbox of shares, angle), and the size of what is recognised after turning and padding. Pages
    are (page_id, width, height); pictures of more than most_pixels are scaled down first. Types that
    aren't recognised, and crops without a pixel, are left out."""
    fit = pages.select("page_id", G.fitted(F.col("width"), F.col("height"), most_pixels).alias("fit"))
    cut = to_extract(blocks).join(fit, "page_id").withColumn("crop", G.crop_rect(F.col("bbox"), F.col("fit.width"), F.col("fit.height")))
    turned = F.coalesce(F.col("angle"), F.lit(0)).isin(90, 270)
    w, h = F.when(turned, F.col("crop.height")).otherwise(F.col("crop.width")), F.when(turned, F.col("crop.width")).otherwise(F.col("crop.height"))
    return cut.where("crop.width >= 1 and crop.height >= 1").select("page_id", "idx", "crop", G.padded(w, h).alias("size"))


def param_runs(requests: DataFrame, by: str, order: str, params: list[str]) -> DataFrame:
    """Requests with `run`: runs of neighbours with the same settings, numbered from 0 on. A model that
    takes one setting at a time is given one run after the other."""
    w = Window.partitionBy(by).orderBy(order)
    now = F.struct(*params)
    changed = F.coalesce((~now.eqNullSafe(F.lag(now).over(w)) & F.lag(order).over(w).isNotNull()).cast("int"), F.lit(0))
    return requests.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w).cast("int")).drop("_new")


def merged_params(requests: DataFrame, own: dict[str, float], names: list[str]) -> DataFrame:
    """Each setting as the request has it, else as the client does."""
    return requests.withColumns({n: F.coalesce(F.col(n), F.lit(own.get(n))) if n in requests.columns else F.lit(own.get(n)) for n in names})


def restore_page_ids(results: DataFrame, wanted: DataFrame, key: str = "doc_id", page: str = "page_id") -> DataFrame:
    """Results of projected documents with their pages' numbers in the whole document, by the lists
    (key, page_ids) that they were projected with; numbers outside of a list, and documents without
    one, stay as they are."""
    joined = results.join(wanted.select(key, "page_ids"), key, "left")
    back = F.when(F.col(page) >= 0, F.get("page_ids", F.col(page).cast("int")))
    return joined.withColumn(page, F.coalesce(back, F.col(page))).drop("page_ids")


def content_blocks(blocks: DataFrame) -> DataFrame:
    """(page_id, type, angle, index, pos, text) of blocks that carry text; tables and pictures don't."""
    own = blocks.where(~F.col("type").isin("image", "table") & F.col("content").isNotNull())
    return own.select("page_id", F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("angle", F.lit(0)).alias("angle"), F.col("idx").alias("index"), F.array("x0", "y0", "x1", "y1").alias("pos"), F.col("content").alias("text"))
