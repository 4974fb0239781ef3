"""Vocabularies, request settings and row types of recognised page layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# The block types of layouts, in their usual order.
BLOCK_TYPES = [
    "text", "title", "table", "image", "code", "algorithm", "header", "footer", "page_number",
    "page_footnote", "aside_text", "equation", "equation_block", "ref_text", "list", "phonetic",
    "table_caption", "image_caption", "code_caption", "table_footnote", "image_footnote", "unknown",
    "seal", "char",
]
# Types beside the running text, which may be dropped.
PARATEXT = ["header", "footer", "page_number", "aside_text", "page_footnote", "unknown"]
# Types never sent to the recogniser.
NOT_EXTRACTED = ["image", "list", "equation_block"]
# Types that give a line of their own text in Markdown.
PLAIN_TYPES = ["text", "interline_equation", "phonetic", "ref_text", "footer", "header"]
# Words in a layout line's tail and their angles; the first one found counts.
ANGLES = {"up": 0, "right": 90, "down": 180, "left": 270}
# Prompts by type; other types take the default.
PROMPTS = {
    "text": "\nPlease output the text content from the image.",
    "table": "\nThis is the image of a table. Please output the table in OTSL format.",
    "equation": "\nPlease write out the expression of the formula in the image using LaTeX format.",
    "code": "\nThe image contains a code snippet, please output the parsing result.",
    "layout": "\nAnalyze the image layout.",
    "seal": "\nSeal Recognition:",
    "char": "\nThis is a scientific figure. Please extract the table implied by this figure.",
    "default": "\nPlease output the text content from the image.",
    "table_structure": "\nTable Recognition:",
    "formula_structure": "\nFormula Recognition:",
}
# Penalties by type; the rest of the settings is the same for all.
FREQUENCY_PENALTY = {"text": 0.05, "table": 0.005, "equation": 0.05, "code": 0.05, "char": 0.005, "seal": 0.005, "default": 0.05, "table_structure": 0.005, "formula_structure": 0.05}
SAMPLING = {"temperature": 0.0, "top_p": 0.01, "top_k": 1, "repetition_penalty": 1.0, "no_repeat_ngram_size": 100}
# Order in which classes of blocks are listed on a page.
CLASS_ORDER = ["image", "table", "code", "ref_text", "phonetic", "title", "text", "interline_equation", "list", "seal", "char", "discarded"]

BLOCK = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("angle", T.IntegerType()), T.StructField("content", T.StringType()),
])
