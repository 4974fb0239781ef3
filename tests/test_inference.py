"""Two-step reading: who is asked, how often, and what becomes of requests that fail."""

import os
import threading
import time
import uuid

import pytest

from quireworks.operators import inference
from quireworks.operators.inference import Limits, ask, calls

PAGES = "page_id long, doc_id long, page_idx int, image binary, width int, height int"
LAYOUT = "<box:0 0 500 100><label:title><|rotate_up|>\n<box:0 200 900 400><label:image><|rotate_up|>\n<box:0 400 900 450><label:text><|rotate_up|>"


def counted(folder, fails=lambda image, prompt: False):
    """A maker of models that leave a file for each call."""
    echo = inference.echo

    def make():
        answer = echo()

        def model(images, prompts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{len(images)} {len({id(i) for i in images})} {prompts[0].strip()[:7]}")
            if any(fails(i, p) for i, p in zip(images, prompts, strict=True)):
                raise OSError("out of order")
            return answer(images, prompts)

        return model

    return make


def noted(folder):
    return sorted((folder / x).read_text() for x in os.listdir(folder))


def test_each_model_is_asked_once(spark, tmp_path):
    inference.register("once", counted(str(tmp_path)), Limits(requests=1))
    inference.register("once-contents", counted(str(tmp_path)), Limits(requests=100))
    pages = spark.createDataFrame([(i, i // 3, i % 3, LAYOUT.encode(), 200, 100) for i in range(12)], PAGES).repartition(3)
    out = inference.parse_documents(pages, "once", "once-contents")
    assert out.count() == 4 and len(out.collect()) == 4
    got = [x.split(" ", 2) for x in noted(tmp_path)]
    layouts = [x for x in got if x[2] == "Analyze"]
    others = [x for x in got if x[2] != "Analyze"]
    assert len(layouts) == 12
    assert sum(int(n) for n, *_ in others) == 24 and sum(int(n) for _, n, _ in others) == 12 and len(others) <= 3  # a picture a page
    plan = inference.read_contents(inference.read_layouts(pages, "once"), "once-contents")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the test's own repartition


def test_limits_of_a_call():
    a, b = b"x" * 10, b"y" * 10
    requests = [(a, "1"), (a, "2"), (b, "3"), (b, "4"), (None, "5"), (b"z" * 100, "6"), (a, "7")]
    sizes = [len(c) for c in calls(requests, Limits(requests=10, picture_bytes=25))]
    assert sizes == [5, 1, 1]
    assert [len(c) for c in calls(requests, Limits(requests=2))] == [2, 2, 2, 1]
    assert list(calls([], Limits())) == []


def test_open_calls_and_order():
    now, most, lock = 0, 0, threading.Lock()

    def model(images, prompts):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 if int(prompts[0]) % 3 else 0.06)
        with lock:
            now -= 1
        return [f"<{p}>" for p in prompts]

    taken = []

    def requests():
        for i in range(40):
            taken.append(i)
            yield None, str(i)

    answers = ask(model, requests(), Limits(requests=2, open_calls=4))
    first = next(answers)
    assert first == ("<0>", None) and len(taken) < 15  # no more are taken than needed
    assert [first, *answers] == [(f"<{i}>", None) for i in range(40)]
    assert most == 4


def test_failures_are_asked_one_by_one():
    tries = []

    def model(images, prompts):
        tries.append(list(prompts))
        if "bad" in prompts or "twice" in prompts and tries.count(["twice"]) < 2:
            raise OSError("no")
        return [p.upper() for p in prompts] if prompts != ["short"] else []

    got = list(ask(model, [(None, p) for p in ("a", "bad", "twice", "b", "short")], Limits(requests=4, retries=1)))
    assert got == [("A", None), (None, "OSError: no"), ("TWICE", None), ("B", None), (None, "ValueError: a model must give one answer for each request")]


def test_errors_of_pages(spark, tmp_path):
    inference.register("some", counted(str(tmp_path), lambda image, prompt: image == b"broken" or b"title" in image and b"seal" in image and "text" in prompt))
    rows = [(1, 1, 0, LAYOUT.encode(), 10, 10), (2, 1, 1, b"broken", 10, 10), (3, 2, 0, (LAYOUT + "\n<box:0 0 9 9><label:seal>").encode(), 10, 10), (4, 3, 0, None, 10, 10)]
    pages = spark.createDataFrame(rows, PAGES)
    read = {r.page_id: r for r in inference.read_pages(pages, "some").collect()}
    assert [read[i].error for i in (1, 2, 3)] == [None, "OSError: out of order", "OSError: out of order"] and read[4].error.startswith("TypeError")
    assert [b.type for b in read[1].blocks] == ["title", "image", "text"] and read[1].contents[1] is None and read[1].contents[0].endswith("the image.")
    assert {b.page_id for b in inference.blocks_of_pages(inference.read_pages(pages, "some")).collect()} == {1}
    with pytest.raises(Exception, match="out of order"):
        inference.parse_documents(pages.where("page_id = 2"), "some").collect()
    with pytest.raises(Exception, match="out of order"):
        inference.recognise(spark.createDataFrame([(1, b"broken", "x")], "id int, image binary, prompt string"), "some").collect()
