"""Greedy matching and suppression against plain loops over random pages."""

import collections
import random

from quireworks.operators import structure, suppress

BOXES = "page_id long, idx int, x0 int, y0 int, x1 int, y1 int"


def gap(a, b):
    dx, dy = (max(b[k] - a[k + 2], a[k] - b[k + 2], 0) for k in (0, 1))
    return (dx * dx + dy * dy) ** 0.5


def matched(subjects, objects):
    """[(subject, object or None)] of {index: box}: the free item next to the free ones' upper left corner
    meets the nearest free one of the other kind, or steps back if it is a subject and another one is
    at most a third as far."""
    near = lambda boxes: sorted(boxes, key=lambda i: (boxes[i][0] ** 2 + boxes[i][1] ** 2, i))
    free = [("s", i) for i in near(subjects)] + [("o", i) for i in near(objects)]
    order = {x: k for k, x in enumerate(free)}
    box = lambda x: (subjects if x[0] == "s" else objects)[x[1]]
    out, pairs = [], 0
    while free and pairs < len(subjects):
        left, top = min(box(x)[0] for x in free), min(box(x)[1] for x in free)
        free.sort(key=lambda x: ((box(x)[0] - left) ** 2 + (box(x)[1] - top) ** 2, order[x]))
        first = free[0]
        others = [x for x in free if x[0] != first[0]]
        if not others:
            break
        second = min(others, key=lambda x: (gap(box(first), box(x)), free.index(x)))
        s, o = (first, second) if first[0] == "s" else (second, first)
        free.remove(s)
        if gap(box(s), box(o)) < 3 * min(gap(b, box(o)) for b in subjects.values()):
            free.remove(o)
            out.append((s[1], o[1]))
            pairs += 1
    if subjects:
        out += [(min(subjects, key=lambda i: (gap(subjects[i], box(o)), order["s", i])), o[1]) for o in free if o[0] == "o"]
    return out + [(i, None) for i in subjects if i not in {s for s, _ in out}]


def test_greedy_matching(spark):
    rng = random.Random(2)
    pages = {}
    for p in range(120):
        make = lambda n: {i: (x := rng.randrange(0, 200), y := rng.randrange(0, 200), x + rng.randrange(1, 60), y + rng.randrange(1, 60)) for i in range(n)}
        pages[p] = make(rng.randrange(0, 7)), make(rng.randrange(0, 7))
    frames = [spark.createDataFrame([(p, i, *b) for p, kinds in pages.items() for i, b in kinds[k].items()], BOXES) for k in (0, 1)]
    got = collections.defaultdict(list)
    for r in structure.match_greedily(*frames).collect():
        got[r.page_id].append((r.sub_idx, r.obj_idx))
    for p, kinds in pages.items():
        assert sorted(got[p], key=str) == sorted(matched(*kinds), key=str)


def meet(a, b):
    w, h = (max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    return w * h


def size(a):
    return max(0, a[2] - a[0]) * max(0, a[3] - a[1])


def around(a, b):
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def within(a, b):
    return meet(a, b) > 0 and meet(a, b) >= 0.8 * size(a)


def merged(tables):
    tables = [list(t) for t in tables]
    pairs = [(i, j) for i in range(len(tables)) for j in range(i + 1, len(tables))]
    for i, j in pairs:
        a, b = tables[i], tables[j]
        both = meet(a[0], b[0])
        if both and both / (size(a[0]) + size(b[0]) - both) > 0.7:
            rest = [t for k, t in enumerate(tables) if k not in (i, j)]
            return merged([*rest, [around(a[0], b[0]), *a[1:]]])
    return tables


def unnested(tables):
    out = []
    for t in tables:
        held = [x[0] for x in tables if x is not t and within(x[0], t[0])]
        touch = any(meet(a, b) for i, a in enumerate(held) for b in held[:i])
        if not (len(held) >= 3 and not touch and sum(map(size, held)) > 0.8 * size(t[0])):
            out.append(t)
    return out


def absorbed(boxes):
    boxes, gone = [list(b) for b in boxes], []
    for i in range(len(boxes)):
        if i in gone:
            continue
        for j in range(i + 1, len(boxes)):
            if j in gone:
                continue
            s, g = (i, j) if size(boxes[i][0]) <= size(boxes[j][0]) else (j, i)
            least = size(boxes[s][0])
            if least and meet(boxes[s][0], boxes[g][0]) / least > 0.8:
                if boxes[s][2] <= boxes[g][2]:
                    if s not in gone:
                        boxes[g][0] = around(boxes[g][0], boxes[s][0])
                    gone.append(s)
                else:
                    gone.append(g)
    return [b for k, b in enumerate(boxes) if k not in gone]


def without_containers(boxes):
    now = {k: list(b) for k, b in enumerate(boxes)}
    for i, b in enumerate(boxes):
        held = [j for j in now if j != i and within(boxes[j][0], b[0])] if i in now else []
        if len(held) >= 2:
            if b[2] > sum(boxes[j][2] for j in held) / len(held):
                for j in held:
                    now[i][0] = around(now[i][0], boxes[j][0])
                    del now[j]
            else:
                del now[i]
    return [*now.values()]


def left(boxes):
    of = lambda *kinds: [b for b in boxes if b[1] in kinds]
    known = (0, 1, 2, 3, 4, 5, 6, 7)
    kept = without_containers([*of(0, 2, 3, 4, 6, 7), *absorbed(of(1)), *absorbed(unnested(merged(of(5))))])
    return [*kept, *(b for b in boxes if b[1] not in known)]


def test_suppression(spark):
    rng = random.Random(6)
    pages, rows = {}, []
    for p in range(200):
        boxes = []
        for i in range(rng.randrange(0, 12)):
            x, y = rng.choice([0, 0, 10, 20, 30]), rng.choice([0, 0, 10, 20, 30])
            b = [x, y, x + rng.choice([0, 9, 10, 30, 40]), y + rng.choice([9, 10, 12, 36])]
            score = rng.choice([None, 0.2, 0.5, 0.7, 0.9])
            boxes.append([b, rng.choice([0, 1, 1, 3, 5, 5, 5, 13]), 0.5 if score is None else score])
            rows.append((p, i, boxes[-1][1], [float(v) for v in (b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])], score))
        pages[p] = left(boxes)
    got = collections.defaultdict(list)
    for r in suppress.suppress(spark.createDataFrame(rows, "page_id long, idx int, category_id int, poly array<double>, score double")).orderBy("page_id", "position").collect():
        got[r.page_id].append([[r.x0, r.y0, r.x1, r.y1], r.category_id, r.score])
    assert dict(got) == {p: b for p, b in pages.items() if b}
