"""Suppression among detected boxes. The order of steps matters, so a page is worked on as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pages import on_pages


def _meet(a: list, b: list) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _area(a: list) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def _around(a: list, b: list) -> list:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def merge_tables(boxes: list[dict], least: float = 0.7) -> list[dict]:
    """The first pair that overlaps by more than `least` becomes one box at the end, until none does."""
    boxes = list(boxes)
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j in range(i + 1, len(boxes)) if (m := _meet(a["box"], boxes[j]["box"])) and m / (_area(a["box"]) + _area(boxes[j]["box"]) - m) > least), None)
            if j is not None:
                joined = {**a, "box": _around(a["box"], boxes[j]["box"])}
                boxes = [x for k, x in enumerate(boxes) if k not in (i, j)] + [joined]
                break
        else:
            return boxes


def _inside(a: list, b: list, least: float) -> bool:
    return (m := _meet(a, b)) > 0 and m >= least * _area(a)


def drop_nested_tables(boxes: list[dict], least: float = 0.8, share: float = 0.8) -> list[dict]:
    """Without those that hold three others and more, apart from each other, whose areas sum to more
    than `share` of theirs."""
    out = []
    for i, a in enumerate(boxes):
        held = [b["box"] for j, b in enumerate(boxes) if j != i and _inside(b["box"], a["box"], least)]
        apart = not any(_meet(x, y) for k, x in enumerate(held) for y in held[k + 1 :])
        if len(held) < 3 or not apart or sum(map(_area, held)) <= share * _area(a["box"]):
            out.append(a)
    return out


def absorb_small(boxes: list[dict], least: float = 0.8) -> list[dict]:
    """A box of which another one covers more than `least` goes into it, or drops it by its score."""
    alive = [dict(b) for b in boxes]
    gone: set[int] = set()
    for i in range(len(alive)):
        if i in gone:
            continue
        for j in range(i + 1, len(alive)):
            if j in gone:  # i goes on to the end even if it has just been dropped
                continue
            a, b = alive[i], alive[j]
            small = min(_area(a["box"]), _area(b["box"]))
            if not small or _meet(a["box"], b["box"]) / small <= least:
                continue
            s, g = (i, j) if _area(a["box"]) <= _area(b["box"]) else (j, i)
            if alive[s]["score"] <= alive[g]["score"]:
                if s not in gone:
                    alive[g]["box"] = _around(alive[g]["box"], alive[s]["box"])
                gone.add(s)
            else:
                gone.add(g)
    return [b for k, b in enumerate(alive) if k not in gone]


def drop_unsure_containers(boxes: list[dict], least: float = 0.8) -> list[dict]:
    """A box that holds two others and more stays, grown around them, if it scores above their mean,
    and they go; else it goes and they stay. What has gone holds nothing and is held by nothing;
    who holds whom is a matter of the boxes as they were."""
    out = {i: dict(b) for i, b in enumerate(boxes)}
    for i, a in enumerate(boxes):
        if i not in out:
            continue
        held = [j for j in out if j != i and _inside(boxes[j]["box"], a["box"], least)]
        if len(held) < 2:
            continue
        if a["score"] > sum(boxes[j]["score"] for j in held) / len(held):
            for j in held:
                out[i]["box"] = _around(out[i]["box"], boxes[j]["box"])
                del out[j]
        else:
            del out[i]
    return list(out.values())


TABLE, TEXT, OTHER = 5, 1, (0, 2, 3, 4, 6, 7)


def page_boxes(boxes: list[dict]) -> list[dict]:
    """What a page's boxes come to: tables are merged, freed of nested ones and absorb each other,
    text boxes absorb each other, and containers are sought among these and OTHER together. Boxes
    of further categories, formulas among them, stay as they are and come last."""
    of = lambda kinds: [b for b in boxes if b["category"] in kinds]
    tables = absorb_small(drop_nested_tables(merge_tables(of((TABLE,)))))
    left = drop_unsure_containers([*of(OTHER), *absorb_small(of((TEXT,))), *tables])
    return [*left, *(b for b in boxes if b["category"] not in (TABLE, TEXT, *OTHER))]


def suppress(detections: DataFrame) -> DataFrame:
    """(page_id, category_id, x0, y0, x1, y1, score, position) of what page_boxes leaves of each page's
    detections (page_id, idx, category_id, poly, score), taken in the order of idx. No score: 0.5."""

    def page(rows: list[dict]) -> list[tuple]:
        boxes = [{"box": [int(r["poly"][k]) for k in (0, 1, 4, 5)], "category": r["category_id"], "score": 0.5 if r["score"] is None else r["score"]} for r in rows]
        return [(rows[0]["page_id"], b["category"], *map(float, b["box"]), float(b["score"]), k) for k, b in enumerate(page_boxes(boxes))]

    return on_pages(detections.select("page_id", "idx", "category_id", "poly", "score"), page, "page_id long, category_id int, x0 double, y0 double, x1 double, y1 double, score double, position int", ["idx"])
