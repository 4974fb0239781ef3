"""Whole pages against a plain rendering of the rules, block by block."""

import collections
import json
import math
import random

from pyspark.sql import functions as F

from quireworks.functions.text import merged_lines
from quireworks.operators import assemble
from quireworks.plans.catalog import QUERIES
from quireworks.sources import derived

SCHEMA = "page_id long, idx int, type string, x0 int, y0 int, x1 int, y1 int, angle int, content string, image_path string"
SIMPLE = {"text", "title", "ref_text", "phonetic", "header", "footer", "page_number", "aside_text", "page_footnote", "seal", "char", "list"}


def inside(a, b):
    return b["x0"] <= a["x0"] and b["y0"] <= a["y0"] and a["x1"] <= b["x1"] and a["y1"] <= b["y1"]


def share(a, b):
    w, h = (max(0, min(a[p + "1"], b[p + "1"]) - max(a[p + "0"], b[p + "0"])) for p in "xy")
    own = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return w * h / own if own else 0


def center(b):
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def family(page, kind):
    """(body, captions, footnotes) of a page, by index."""
    kinds = {kind, "algorithm"} if kind == "code" else {kind}
    apart = lambda rows: [a for a in rows if not any(inside(a, b) for b in rows if b is not a)]
    bodies = apart([b for b in page if b["type"] in kinds])
    parts = {b["idx"]: ([], []) for b in bodies}
    if not bodies:
        return []
    stray = []
    for side, name in enumerate(("caption", "footnote")):
        for x in apart([b for b in page if b["type"] == f"{kind}_{name}"]):
            near = min(bodies, key=lambda b: (abs(b["idx"] - x["idx"]), round(math.dist(center(b), center(x)), 9), b["idx"]))
            if side and kind != "code" and x["idx"] < near["idx"]:
                stray.append((x, near))
            else:
                parts[near["idx"]][side].append(x["idx"])
    for x, near in stray:
        before = [b["idx"] for b in bodies if b["idx"] <= x["idx"] and b is not near]
        if before:
            parts[max(before)][1].append(x["idx"])
    out = []
    for body, (caps, notes) in parts.items():
        caps, notes = sorted(caps, reverse=True), sorted(notes)
        if kind != "code":
            for rows, step in ((caps, -1), (notes, 1)):
                for k in range(1, len(rows)):
                    between = set(range(rows[k - 1] + step, rows[k], step))
                    if between and not (step < 0 and between == {body}):
                        del rows[k:]
                        break
        out.append((body, sorted(caps), notes))
    return out


def paragraphs(page):
    """(top index, kind, sub type, blocks as (part, block)) in order."""
    rows = {b["idx"]: b for b in page}
    out, used = [], set()
    texts = [b for t in ("text", "ref_text") for b in sorted(page, key=lambda b: b["idx"]) if b["type"] == t]
    items = collections.defaultdict(list)
    for b in texts:
        first = next((x["idx"] for x in sorted(page, key=lambda b: b["idx"]) if x["type"] == "list" and share(b, x) >= 0.8), None)
        if first is not None:
            items[first].append(b)
            used.add(b["idx"])
    for idx, members in items.items():
        counts = collections.Counter(b["type"] for b in members)
        out.append((idx, "list", max(counts, key=counts.get), [("item", b) for b in members]))
    for kind in ("image", "table", "code"):
        for body, caps, notes in family(page, kind):
            parts = [("body", rows[body]), *(("caption", rows[i]) for i in caps), *(("footnote", rows[i]) for i in notes)]
            used.update(b["idx"] for _, b in parts)
            out.append((body, kind, rows[body]["type"] if kind == "code" else None, sorted(parts, key=lambda p: p[1]["idx"])))
    loose = {f"{k}{p}" for k in ("image", "table", "code") for p in ("", "_caption", "_footnote")} | {"algorithm"}
    for b in page:
        if b["idx"] in used or b["type"] == "list":
            continue
        kind = "text" if b["type"] in loose else "interline_equation" if b["type"] == "equation" else b["type"]
        if kind in SIMPLE or kind == "interline_equation":
            out.append((b["idx"], kind, None, [("self", b)]))
    return sorted(out, key=lambda p: p[0])


def code_of(b):
    lines = (b["content"] or "").splitlines()
    if lines and lines[0][:3] == "```":
        lines.pop(0)
    if lines and lines[-1].strip() == "```":
        lines.pop()
    text = "\n".join(lines).strip()
    if text.startswith("<_") and "_>" in text:
        mark, _, rest = text[2:].partition("_>")
        return mark.lower(), rest
    return "txt", text


def piece(b, kind=None):
    text = "" if b["type"] in ("image", "table") else code_of(b)[1] if b["type"] in ("code", "algorithm") else b["content"] or ""
    if b["type"] == "title":
        while "\n" in text:
            head, _, tail = text.partition("\n")
            text = head + " " + tail.lstrip()
    text = text.strip()
    if b["type"] == "equation" or not text or (text.endswith("-") and text[-2:-1].isascii() and text[-2:-1].isalpha()):
        return text
    return text + " "


def markdown(page, folder):
    shown = []
    for _, kind, sub, parts in paragraphs(page):
        of = lambda name: [b for p, b in parts if p == name]
        first = parts[0][1]
        if kind == "list":
            md = "".join(piece(b) + "  \n" for b in of("item"))
        elif kind == "image":
            link = "".join(f"![]({folder}/{b['image_path']})" for b in of("body") if b["image_path"])
            if of("footnote"):
                md = "".join(piece(b) + "  \n" for b in of("caption")) + link + "".join("  \n" + piece(b) for b in of("footnote"))
            else:
                md = link + "".join("  \n" + piece(b) for b in of("caption"))
        elif kind == "table":
            body = of("body")[0]
            inner = f"\n{body['content']}\n" if body["content"] else f"![]({folder}/{body['image_path']})" if body["image_path"] else ""
            md = "".join(piece(b) + "  \n" for b in of("caption")) + inner + "".join("\n" + piece(b) + "  " for b in of("footnote"))
        elif kind == "code":
            body = of("body")[0]
            md = "".join(piece(b) + "  \n" for b in of("caption")) + (f"```{code_of(body)[0]}\n{piece(body)}\n```" if sub == "code" else piece(body))
        elif kind == "title":
            md = "# " + piece(first)
        elif kind == "char":
            md = first["content"] if len(first["content"] or "") > 5 else ""
        else:
            md = piece(first) if kind in ("text", "interline_equation", "phonetic", "ref_text", "footer", "header") else ""
        if md.strip():
            shown.append(md.strip())
    return "\n\n".join(shown)


def pages_of(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["page_id"]].append(r)
    return out


def random_pages(seed, n):
    rng = random.Random(seed)
    kinds = ["image", "image_caption", "image_footnote", "table", "table_caption", "table_footnote", "code", "algorithm", "code_caption", "list", "text", "ref_text", "title", "equation", "seal", "char", "unknown", "header", "page_number", "equation_block"]
    words = [None, "", "  ", "a long one-", "two\n  lines", "<_Java_>x = 1;", "```py\r\n <_C_>int x;\n  ```", "```", "```\n```\n", "E = mc", "plain text\n", "123456", "\x0b\x1codd　", "in the- "]
    rows = []
    for p in range(n):
        for i in sorted(rng.sample(range(40), rng.randrange(0, 22))):
            x, y = rng.randrange(0, 60), rng.randrange(0, 60)
            w, h = rng.choice([(0, 5), (10, 10), (20, 8), (60, 70)])
            rows.append(dict(zip(SCHEMA.replace(",", "").split()[::2], (p, i, rng.choice(kinds), x, y, x + w, y + h, rng.choice([0, 90, None]), rng.choice(words), rng.choice([None, "", f"i{i}.jpeg"])), strict=True)))
    return rows


def test_random_pages(spark):
    rows = random_pages(11, 150)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    pages = pages_of(rows)
    got = {r.page_id: r.markdown for r in assemble.markdown(df, "images").collect()}
    assert got == {p: m for p, b in pages.items() if (m := markdown(b, "images"))}
    parts = collections.defaultdict(list)
    for r in assemble.paragraphs(df).orderBy("page_id", "top_idx").collect():
        parts[r.page_id].append((r.top_idx, r.kind, r.sub_type, [(x.part, x.idx) for x in r.parts if not (r.kind == "list" and x.part == "self")]))
    assert parts == {p: q for p, b in pages.items() if (q := [(t, k, s, [(n, x["idx"]) for n, x in m]) for t, k, s, m in paragraphs(b)])}


def test_lines_are_merged(spark):
    rng = random.Random(8)
    contents = ["plain", "well-", "  spaced ", "", None, "Upper", "ends in-", "x-1", "汉字", "ＡＢ", "lower case"]
    paras = [[[(rng.choice(["text", "text", "text", "inline_equation", "interline_equation", "image"]), rng.choice(contents)) for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 5))] for _ in range(300)]

    def half(c):
        return "".join(chr(ord(x) - 0xFEE0) if "Ａ" <= x <= "Ｚ" else x for x in c)

    def merged(lines):
        lines = [[(k, half(c) if k == "text" and c is not None else c) for k, c in line] for line in lines]
        whole = "".join(c or "" for line in lines for k, c in line if k == "text")
        dense = 3 * sum("一" <= x <= "鿿" for x in whole) > len("".join(whole.split()))
        out = ""
        for i, line in enumerate(lines):
            for j, (k, c) in enumerate(line):
                c, last = (c or "").strip(), j == len(line) - 1
                if not c or k not in ("text", "inline_equation", "interline_equation"):
                    continue
                if k == "interline_equation" or dense and last and k == "text":
                    out += c
                elif not dense and last and k == "text" and len(c) > 1 and c[-1] == "-" and c[-2].isascii() and c[-2].isalpha():
                    after = lines[i + 1][0] if i + 1 < len(lines) and lines[i + 1] else ("", "")
                    out += c[:-1] if after[0] == "text" and after[1] and after[1][0].islower() else c
                else:
                    out += c + " "
        return out

    df = spark.createDataFrame(list(enumerate(paras)), "i int, lines array<array<struct<type:string,content:string>>>")
    assert [r[0] for r in df.orderBy("i").select(merged_lines(F.col("lines"))).collect()] == list(map(merged, paras))


def test_kinds_are_dropped(spark):
    rows = random_pages(12, 30)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    kinds = {p["kind"] for r in assemble.page_paragraphs(df, assemble.NO_PICTURES).collect() for p in r.paras}
    assert kinds and not kinds & set(assemble.NO_PICTURES)


def test_documents_of_derived_pages(spark, data):
    rows = [r.asDict() | {"image_path": None} for r in derived.blocks(spark, data).collect()]
    pages = pages_of(rows)
    box = lambda b: [b["x0"], b["y0"], b["x1"], b["y1"]]

    def span(b):
        kind = {"image": "image", "table": "table", "equation": "interline_equation", "seal": "seal", "char": "char"}.get(b["type"], "text")
        text = code_of(b)[1] if b["type"] in ("code", "algorithm") else " ".join([(x := b["content"].split("\n"))[0], *(y.lstrip() for y in x[1:])]).strip() if b["type"] == "title" else b["content"]
        return {"bbox": box(b), "type": kind} | ({"html": text} if kind == "table" else {} if kind == "image" else {"content": text})

    found = 0
    for r in QUERIES["doc_json"](spark, data).collect():
        doc = json.loads(r.document)
        assert doc["_backend"] == "vlm" and [p["page_idx"] for p in doc["pdf_info"]] == sorted(k % 3 for k in pages if k // 3 == r.doc_id and paragraphs(pages[k]))
        for info in doc["pdf_info"]:
            want = paragraphs(pages[r.doc_id * 3 + info["page_idx"]])
            assert [(p["type"], p.get("sub_type")) for p in info["para_blocks"]] == [(k, s) for _, k, s, _ in want]
            for i, (p, (_, kind, sub, parts)) in enumerate(zip(info["para_blocks"], want, strict=True)):
                assert p["index"] == i and ("guess_lang" in p) == (sub == "code")
                if kind not in ("image", "table", "code", "list"):
                    b = parts[0][1]
                    if b["type"] not in ("image", "table"):
                        assert p["lines"] == [{"bbox": box(b), "spans": [span(b)]}] and p["bbox"] == box(b)
                    continue
                assert [(x["index"], x["lines"][0]["spans"][0]) for x in p["blocks"]] == [(b["idx"], span(b)) for _, b in parts]
                found += 1
    assert found > 100
