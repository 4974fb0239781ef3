"""Hand-derived cases of repairs, and properties that hold for any input."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quireworks.functions import latex as L
from quireworks.functions import tables as TB
from quireworks.functions import text as X
from pyspark.sql import functions as F


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


@pytest.mark.parametrize(
    "f, given_, wanted",
    [
        (L.close_environments, r"$$\begin{align}\begin{bmatrix}a&b$$", r"$$\begin{align}\begin{bmatrix}a&b\end{bmatrix}\end{align}$$"),
        (L.close_environments, r"$$\begin{align}\begin{bmatrix}a\end{align}\end{align} z$$", r"$$\begin{align}\begin{bmatrix}a\end{bmatrix}\end{align}\end{align} z$$"),
        (L.balance_delimiters, r"$$\left( x + y$$", r"$$\left( \right. x + y$$"),
        (L.balance_delimiters, r"$$a & \rightarrow b$$", r"$$a&\rightarrow b$$"),
        (L.balance_delimiters, r"\begin{array}{c} \left( a & b \end{array}", r"\begin{array}{c}\left( \right. a&b\end{array}"),
        (L.balance_braces, "a}b{c", "abc"),
        (L.balance_braces, r"\{a{b}", r"\{a{b}"),
        (L.tighten_spaces, r"\alpha x + y", r"\alpha x+y"),
        (L.tighten_spaces, r"\P x \ab2 x \ab_ x  a\ ", "\\Px\\ab2x\\ab_xa\\ "),
        (L.tighten_spaces, " \t\\ab -1 \\\\ x ", "\\ab-1\\\\ x"),
    ],
)
def test_stack_repairs(f, given_, wanted):
    assert f(given_) == wanted


def test_column_repairs(spark):
    wrap = lambda c: L.wrap_display(c)
    assert one(spark, L.strip_brackets, r"$$\[\frac{1}{2}\]$$", r"\(x\)", "x") == [r"$$\frac{1}{2}$$", "x", "x"]
    assert one(spark, wrap, "E=mc^2 (1-2)", "E=mc^2(.a-1)", r"E=mc^2\eqno (1-2)", "y=f(x)", "x tag{2}") == ["$E=mc^2$ (1-2)", "$$E=mc^2(.a-1)$$", r"$$E=mc^2\eqno (1-2)$$", "$y=f$ (x)", r"$$x \tag{2}$$"]
    assert one(spark, L.to_latex, "$$a≤b$$", "→∅∧∨") == [r"$$a\leq b$$", r"\rightarrow \varnothing \wedge \vee "]
    assert one(spark, L.to_unicode, r"\to \total \Rightarrow") == [r"→ \total ⇒"]
    assert one(spark, L.escape_percent, r"50% \%") == [r"50\% \%"]
    assert one(spark, L.equation, None, "", r"\left( a≤b") == [None, "$$$$", r"$$\left( \right. a\leq b$$"]


def test_text(spark):
    assert one(spark, X.half_width, "ＡＢｃ０９，") == ["ABc09，"]
    assert one(spark, X.ends_in_hyphen, "inter-", "a - ", "well-\n") == [True, False, True]
    assert one(spark, X.code_language, "<_Python_>x", "x") == ["python", "txt"]
    assert one(spark, X.without_fence, "```py\nx = 1\n```", "```\n```", "y") == ["x = 1", "", "y"]
    assert one(spark, X.fold_title, " a\n  b ") == ["a b"]
    assert one(spark, X.joined_piece, "a", "in-", "  ", "汉字文") == ["a ", "in-", "", "汉字文"]


@pytest.mark.parametrize(
    "otsl, wanted",
    [
        ("<fcel>A<lcel><nl><fcel>B<fcel>C<nl>", '<tr><td colspan="2">A</td></tr><tr><td>B</td><td>C</td></tr>'),
        ("<fcel>A<fcel>B<nl><ucel><fcel>C<nl>", '<tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr>'),
        ("<fcel>A<fcel>B<nl><fcel>C<nl>", "<tr><td>A</td><td>B</td></tr><tr><td>C</td><td></td></tr>"),
        ("<fcel>A<nl><nl><fcel>B<nl>", "<tr><td>A</td></tr><tr><td></td></tr>"),
        ('<fcel>a<b & "c"<nl>', "<tr><td>a&lt;b &amp; &quot;c&quot;</td></tr>"),
    ],
)
def test_otsl(otsl, wanted):
    assert TB.to_html(otsl) == f"<table>{wanted}</table>"


def test_otsl_edges(spark):
    assert TB.to_html("") == "" and TB.to_html("<table><tr></tr></table>") == "<table><tr></tr></table>"
    assert one(spark, TB.otsl_html, None, "<fcel>A<nl>") == [None, '<table border="1"><tr><td>A</td></tr></table>']


@given(st.text(alphabet="{}\\ab", max_size=30))
def test_braces_balance_and_stay(s):
    out = L.balance_braces(s)
    assert L.balance_braces(out) == out


@given(st.lists(st.sampled_from([r"\begin{align}", r"\end{align}", r"\begin{cases}", r"\end{cases}", "x", "$$"]), max_size=12))
def test_environments_close(parts):
    out = L.close_environments("".join(parts))
    assert all(out.count(f"\\begin{{{e}}}") <= out.count(f"\\end{{{e}}}") for e in ("align", "cases"))


def spaced(s):
    """Inline formulas by hand: dollars that stand alone and behind no backslash split the text."""
    s = s.replace("$$", "$")
    at = [i for i, c in enumerate(s) if c == "$" and s[i - 1 : i] not in ("$", "\\") and s[i + 1 : i + 2] != "$"]
    if not at or len(at) % 2:
        return s
    cuts = [-1, *at, len(s)]
    out = ""
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = s[lo + 1 : hi]
        if k % 2:
            out += (" " if out and not out[-1].isspace() else "") + "$" + part.strip() + "$"
        else:
            out += (" " if k and part and not part[0].isspace() else "") + part
    return out


def test_inline_math(spark):
    rng = random.Random(5)
    texts = ["a$ x $b", "cost $5", "$$x$$", "", "$", "$ $", " $x$ ", *("".join(rng.choice(["a", "$", "$", " ", "\\", "\x1c", "\u3000", "\n"]) for _ in range(rng.randrange(16))) for _ in range(400))]
    assert one(spark, L.inline_math, None, *texts) == [None, *map(spaced, texts)]


def test_settings_from_columns(spark):
    df = spark.createDataFrame([("3", "x"), ("0", "5"), (None, "-1")], "n string, v string")
    assert [tuple(r) for r in df.select(X.positive_or("n", 9), X.positive_or(F.col("v"), 9)).collect()] == [(3, 9), (9, 5), (9, 9)]
