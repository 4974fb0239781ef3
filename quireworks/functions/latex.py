"""Repair of recognised formulas.

What a regular expression can say is a Column expression; what needs a stack is one Arrow-batched
UDF. All functions take null to null. A repair that fails leaves its input as it was.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, once, strip

# Environments whose begin and end are repaired.
ENVIRONMENTS = [
    "align", "align*", "aligned", "alignedat", "array", "bmatrix", "Bmatrix", "pmatrix", "vmatrix",
    "Vmatrix", "matrix", "smallmatrix", "cases", "dcases", "rcases", "equation", "equation*", "gather",
    "gather*", "multline", "multline*", "split",
]
# Delimiters counted after \left and after \right. The last one of the right side is
# "any character": \rightarrow counts too.
LEFT = [r"\\lbrace", r"\\lVert", r"\\lvert", r"\\rvert", r"\\rVert", r"\\vert", r"\\Vert", r"\\lfloor", r"\\lbrack", r"\\langle", r"\|", r"\\\|", r"\[", r"\]", r"\(", r"\\\{", r"\\\}", r"\."]
RIGHT = [r"\\rbrace", r"\\lVert", r"\\lvert", r"\\rvert", r"\\rVert", r"\\vert", r"\\Vert", r"\\rfloor", r"\\rbrack", r"\\rangle", r"\|", r"\\\|", r"\]", r"\[", r"\)", r"\\\}", r"\\\{", "."]
# Delimiters that close each other; a dot on either side fits any of them.
PAIRS = {
    r"\lbrace": r"\rbrace", r"\lVert": r"\lVert", r"\lvert": r"\lvert", r"\vert": r"\vert", r"\Vert": r"\Vert",
    r"\lfloor": r"\rfloor", r"\lbrack": r"\rbrack", r"\langle": r"\rangle", "|": "|", r"\|": r"\|", "[": "]",
    "]": "[", "(": ")", ")": "(", r"\{": r"\}", r"\}": r"\{", "/": "/",
}
# Delimiters that take part in matching without having a partner.
UNPAIRED = [r"\rvert", r"\rVert"]
# Commands and their characters; of several commands for one character the last is used.
SYMBOLS = {
    r"\geq": "≥", r"\leq": "≤", r"\neq": "≠", r"\approx": "≈", r"\equiv": "≡", r"\sim": "∼", r"\simeq": "≃",
    r"\cong": "≅", r"\propto": "∝", r"\ll": "≪", r"\gg": "≫", r"\prec": "≺", r"\succ": "≻", r"\preceq": "≼",
    r"\succeq": "≽", r"\times": "×", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\cdot": "·", r"\ast": "∗",
    r"\star": "⋆", r"\circ": "∘", r"\bullet": "•", r"\diamond": "⋄", r"\in": "∈", r"\notin": "∉", r"\ni": "∋",
    r"\subset": "⊂", r"\supset": "⊃", r"\subseteq": "⊆", r"\supseteq": "⊇", r"\cup": "∪", r"\cap": "∩",
    r"\emptyset": "∅", r"\varnothing": "∅", r"\forall": "∀", r"\exists": "∃", r"\neg": "¬", r"\land": "∧",
    r"\wedge": "∧", r"\lor": "∨", r"\vee": "∨", r"\therefore": "∴", r"\because": "∵", r"\to": "→",
    r"\rightarrow": "→", r"\leftarrow": "←", r"\leftrightarrow": "↔", r"\Rightarrow": "⇒", r"\Leftarrow": "⇐",
    r"\Leftrightarrow": "⇔", r"\mapsto": "↦", r"\hookrightarrow": "↪", r"\infty": "∞", r"\partial": "∂",
    r"\nabla": "∇", r"\angle": "∠", r"\triangle": "△", r"\square": "□", r"\perp": "⊥", r"\parallel": "∥",
    r"\prime": "′", r"\degree": "°", r"\sum": "∑", r"\prod": "∏", r"\coprod": "∐", r"\int": "∫", r"\oint": "∮",
    r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\epsilon": "ε", r"\varepsilon": "ϵ",
    r"\zeta": "ζ", r"\eta": "η", r"\theta": "θ", r"\vartheta": "ϑ", r"\iota": "ι", r"\kappa": "κ",
    r"\lambda": "λ", r"\mu": "μ", r"\nu": "ν", r"\xi": "ξ", r"\pi": "π", r"\varpi": "ϖ", r"\rho": "ρ",
    r"\varrho": "ϱ", r"\sigma": "σ", r"\varsigma": "ς", r"\tau": "τ", r"\upsilon": "υ", r"\phi": "φ",
    r"\varphi": "ϕ", r"\chi": "χ", r"\psi": "ψ", r"\omega": "ω", r"\Gamma": "Γ", r"\Delta": "Δ", r"\Theta": "Θ",
    r"\Lambda": "Λ", r"\Xi": "Ξ", r"\Pi": "Π", r"\Sigma": "Σ", r"\Upsilon": "Υ", r"\Phi": "Φ", r"\Psi": "Ψ",
    r"\Omega": "Ω", r"\aleph": "ℵ", r"\hbar": "ℏ", r"\ell": "ℓ", r"\Re": "ℜ", r"\Im": "ℑ", r"\wp": "℘",
    r"\mho": "℧", r"\copyright": "©", r"\registered": "®", r"\dagger": "†", r"\ddagger": "‡",
}


def strip_brackets(c: Column) -> Column:
    r"""Without one leading \[ or \( and one trailing \] or \), inside $$ if there are."""
    c = F.regexp_replace(c, r"(?U)^(\$\$)?\s*\\[\[(]\s*", "$1")
    return F.regexp_replace(c, r"(?U)\s*\\[\])]\s*(\$\$)?$", "$1")


def wrap_display(c: Column) -> Column:
    r"""All dollars gone, $$ around; a trailing label in parentheses moves behind, a bare tag gets its backslash."""
    c = F.concat(F.lit("$$"), strip(F.replace(c, F.lit("$"), F.lit(""))), F.lit("$$"))
    label = r"(?U)^\$\$((?-U:[^\n]*?))(?<!\\eqno)(?<!\\eqno )(?<!\\eqno  )(?<!\\eqno   )\s*(\([A-Za-z0-9][A-Za-z0-9.\-]*\))\s*\$\$\s*$"
    moved = F.concat(F.lit("$"), F.regexp_replace(F.regexp_extract(c, label, 1), r"(?U)\s+$", ""), F.lit("$ "), F.regexp_extract(c, label, 2))
    c = F.when(c.rlike(label), moved).otherwise(c)
    return F.regexp_replace(c, r"(?U)(?<!\\)tag\s*\{([^{}]*)\}(?=\s*\$\$\s*$)", r"\\tag{$1}")


def escape_percent(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)%", r"\\%")


def to_latex(c: Column) -> Column:
    """Characters to commands, each followed by a space. Commands are ASCII, so the order is free."""
    for char, command in {v: k for k, v in SYMBOLS.items()}.items():
        c = F.replace(c, F.lit(char), F.lit(command + " "))
    return c


def to_unicode(c: Column) -> Column:
    """Commands that no letter follows to characters, longest first."""
    for command in sorted(SYMBOLS, key=len, reverse=True):
        c = F.regexp_replace(c, re.escape(command) + "(?![A-Za-z])", SYMBOLS[command])
    return c


_COUNT_LEFT, _COUNT_RIGHT = (re.compile("|".join(rf"\\{side}{d}" for d in ds)) for side, ds in (("left", LEFT), ("right", RIGHT)))
_TOKEN = re.compile(f"({_COUNT_LEFT.pattern}|{_COUNT_RIGHT.pattern})")
_NODE = re.compile(r"(&|\\\\|\\begin\{array\}\s*\{[a-zA-Z\s]*\}|\\end\{array\})")
_ENV = re.compile(r"\\(begin|end)\s*\{([^{}]+)\}")
_TAILS = [re.compile(p) for p in (r"\$\$\s*$", r"\\\]\s*$", r"\\end\{equation\*?\}\s*$", r"\\end\{align\*?\}\s*$")]


def close_environments(s: str) -> str:
    """Closes what was opened: inner environments before an outer one's end, the rest before the
    formula's end. An end without a begin stays."""
    open_: list[str] = []

    def at(m: re.Match) -> str:
        kind, env = m.groups()
        if env not in ENVIRONMENTS:
            return m.group()
        if kind == "begin":
            open_.append(env)
            return m.group()
        if env not in open_:
            return m.group()
        before = ""
        while (top := open_.pop()) != env:
            before += f"\\end{{{top}}}"
        return before + m.group()

    s = _ENV.sub(at, s)
    missing = "".join(f"\\end{{{env}}}" for env in reversed(open_))
    if not missing:
        return s
    cut = next((m.start() for p in _TAILS if (m := p.search(s))), len(s))
    return s[:cut] + missing + s[cut:]


def environments_match(s: str) -> bool:
    open_: list[str] = []
    for m in _ENV.finditer(s):
        kind, env = m.groups()
        if env in ENVIRONMENTS:
            if kind == "begin":
                open_.append(env)
            elif not open_ or open_.pop() != env:
                return False
    return not open_


def _side(token: str) -> tuple[str, str] | None:
    """('left' or 'right', delimiter) of a token that takes part in matching."""
    side = "left" if token.startswith("\\left") else "right"
    mark = token[len(side) + 1 :]
    usual = PAIRS if side == "left" else PAIRS.values()
    return (side, mark) if mark == "." or mark in usual or mark in UNPAIRED else None


def _fits(left: tuple[str, str], right: tuple[str, str]) -> bool:
    if left[0] != "left" or right[0] != "right":
        return False
    if left[1] == ".":
        return right[1] == "." or right[1] in PAIRS.values()
    return left[1] in PAIRS and right[1] in (PAIRS[left[1]], ".")


def _balance(texts: list[str]) -> list[str]:
    r"""One cell's texts with \right. behind each unmatched left token and \left. before each right one."""
    parts = [[p for p in _TOKEN.split(t) if p.strip()] for t in texts]
    waiting: list[tuple[tuple[str, str], int, int]] = []
    for i, part in enumerate(parts):
        for j, token in enumerate(part):
            if not _TOKEN.fullmatch(token) or (side := _side(token)) is None:
                continue
            if waiting and _fits(waiting[-1][0], side):
                waiting.pop()
            else:
                waiting.append((side, i, j))
    for (side, _), i, j in waiting:
        parts[i][j] = parts[i][j] + r" \right." if side == "left" else r"\left. " + parts[i][j]
    return ["".join(p) for p in parts]


def balance_delimiters(s: str) -> str:
    r"""\left and \right made to match inside each cell of array environments.

    Without arrays only the text before the first & or \\ is looked at. Arrays are numbered one up
    from the last one opened or closed, so arrays beside each other may share a number, and then
    cells; white space around separators goes.
    """
    if len(_COUNT_LEFT.findall(s)) == len(_COUNT_RIGHT.findall(s)) or s.count(r"\begin{array}") != s.count(r"\end{array}"):
        return s
    nodes = [n.strip() for n in _NODE.split(s.strip()) if n]
    cells: dict[object, list[int]] = {}
    stack: list[list[int]] = []
    last = 0
    for i, n in enumerate(nodes):
        if r"\begin{array}" in n:
            last += 1
            stack.append([last, 0])
        elif n == r"\end{array}":
            if not stack:
                return s
            last = stack.pop()[0]
        elif n in ("&", "\\\\"):
            if stack:
                stack[-1][1] += 1
        elif r"\end{array}" not in n:
            cells.setdefault(tuple(stack[-1]) if stack else None, []).append(i)
    if stack:
        return s
    if not any(r"\begin{array}" in n for n in nodes):
        cells = {None: [0]} if nodes and nodes[0] not in ("&", "\\\\") else {}
    for at in cells.values():
        texts = [nodes[i] for i in at]
        if sum(len(_COUNT_LEFT.findall(t)) for t in texts) != sum(len(_COUNT_RIGHT.findall(t)) for t in texts):
            for i, t in zip(at, _balance(texts), strict=True):
                nodes[i] = t
    return "".join(nodes)


def balance_braces(s: str) -> str:
    """Without braces that nothing matches; a brace behind an odd number of backslashes is text."""
    drop, open_, slashes = set(), [], 0
    for i, c in enumerate(s):
        if c == "{" and not slashes % 2:
            open_.append(i)
        elif c == "}" and not slashes % 2:
            if open_:
                open_.pop()
            else:
                drop.add(i)
        slashes = slashes + 1 if c == "\\" else 0
    drop.update(open_)
    return "".join(c for i, c in enumerate(s) if i not in drop) if drop else s


def tighten_spaces(s: str) -> str:
    r"""Without spaces, but for those behind a backslash and between a \command of two letters and more
    and a letter or digit."""
    keeps = lambda m: m[0] == "\\ " or (m[1] or "").isalpha()
    return re.sub(r"\\(\w{2,}) (?=[^\W_])|\\ | ", lambda m: m[0] if keeps(m) else m[0][:-1], re.sub(r"\s+", " ", s))


def _batched(rule):
    def safe(s):
        if s is None:
            return None
        try:
            return rule(s)
        except Exception:  # a formula that defeats a repair stays as it was
            return s

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(safe)

    return run




def equation(c: Column) -> Column:
    """All repairs of a formula, in their order; the three stack machines in two passes over Python."""
    c = wrap_display(strip_brackets(c))
    c = to_latex(_batched(close_environments)(c))
    c = _batched(lambda s: balance_braces(balance_delimiters(s)))(c)
    return escape_percent(c)


def inline_math(c: Column) -> Column:
    """$$ as $; in a text with pairs of dollars only: no space inside a pair, some outside of it."""
    white = "[" + "".join(f"\\x{{{ord(w):x}}}" for w in WHITE) + "]"

    def spaced(parts: Column) -> Column:
        """Even parts are text, odd ones formulas."""

        def piece(x: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            first = F.when((before == "") & (i == 1) | before.rlike(white + r"\z"), F.lit("")).otherwise(F.lit(" "))
            text = F.when((i == 0) | (x == "") | x.rlike("^" + white), x).otherwise(F.concat(F.lit(" "), x))
            return F.when(i % 2 == 1, F.concat(first, F.lit("$"), strip(x), F.lit("$"))).otherwise(text)

        return F.when((F.size(parts) < 3) | (F.size(parts) % 2 == 0), F.array_join(parts, "$")).otherwise(F.array_join(F.transform(parts, piece), ""))

    # Dollars that split a text stand alone and behind no backslash.
    return once(F.split(F.replace(c, F.lit("$$"), F.lit("$")), r"(?<!\\)(?<!\$)\$(?!\$)", -1), spaced)


def count_left(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_COUNT_LEFT.pattern))


def count_right(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_COUNT_RIGHT.pattern))
