"""Folders to folders: rejects, reruns and kills."""

import json
import os
import struct
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import pdfs

from quireworks.functions import pixels, scans
from quireworks.functions.pdf import Pdf
from quireworks.operators import engine, inference
from quireworks.sources import sink

LAYOUT = b"<box:0 0 500 100><label:title><|rotate_up|>|<box:0 200 900 400><label:image><|rotate_up|>|<box:0 400 900 450><label:text><|rotate_up|>"


def reader(folder):
    """A model that reads a page's layout out of its contents, leaves a file for each call, and fails where the page says so."""

    def make():
        import re
        import uuid

        def model(images, prompts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(len(images)))
            out = []
            for image, prompt in zip(images, prompts, strict=True):
                text = re.search(rb"stream\n(.*?)\nendstream", image, re.S)
                text = text.group(1) if text else image
                if b"FAIL" in text:
                    raise OSError("the model gave up")
                out.append(text[:-2].replace(b"|<box", b"\n<box").decode("latin-1") if "layout" in prompt else f"read: {text[-2:].decode('latin-1').strip()}")
            return out

        return model

    return make


@pytest.fixture
def folders(tmp_path):
    for name in ("in/sub", "out", "calls"):
        (tmp_path / name).mkdir(parents=True)
    for i in range(17):
        (tmp_path / ("in" if i % 2 else "in/sub") / f"doc{i}.pdf").write_bytes(pdfs.of_pages(1 + i % 3, LAYOUT if i else b"blank"))
    (tmp_path / "in/broken.pdf").write_bytes(b"%PDF-1.4 nothing at all")
    (tmp_path / "in/fails.pdf").write_bytes(pdfs.of_pages(2, LAYOUT + b"\nFAIL"))
    (tmp_path / "in/sub/doc1.pdf").write_bytes(pdfs.of_pages(9, LAYOUT))
    return tmp_path


def results(out):
    return sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names if not d.split("/")[-1].startswith("_") and not f.endswith(".crc"))


def test_rejects_kills_and_reruns(spark, folders, monkeypatch):
    inference.register("reader", reader(str(folders / "calls")), inference.Limits(requests=4))
    source, out, calls = str(folders / "in"), str(folders / "out"), folders / "calls"
    run = lambda: {(r.name, r.status): r.reason for r in engine.parse_folder(spark, source, out, "reader").collect()}

    # killed at the commit: nothing is there
    monkeypatch.setattr(sink, "write", lambda rows, folder: rows.count() and (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        run()
    assert results(out) == []
    monkeypatch.undo()

    got = run()
    good = {f"doc{i}" for i in range(17)}
    assert {n for n, s in got if s == "done"} == good and len(got) == 20
    assert got["broken", "rejected"] == "no catalog" and got["fails", "rejected"] == "page 0: OSError: the model gave up"
    assert got["doc1", "rejected"].startswith("another input has this name: ") and got["doc1", "rejected"].endswith("/in/doc1.pdf")
    assert results(out) == sorted(f"{n}/{n}{end}" for n in good for end in (".md", "_layout.pdf", "_middle.json") if (n, end) != ("doc0", "_layout.pdf"))

    assert (folders / "out/doc5/doc5.md").read_text().startswith("# read: 0") and (folders / "out/doc5/doc5.md").read_text().count("read: ") == 6
    info = json.loads((folders / "out/doc5/doc5_middle.json").read_text())
    assert [p["page_idx"] for p in info["pdf_info"]] == [0, 1, 2] and info["pdf_info"][2]["page_size"] == [302, 500]
    assert (folders / "out/doc0/doc0.md").read_text() == "" and json.loads((folders / "out/doc0/doc0_middle.json").read_text())["pdf_info"] == []
    before = (folders / "in/doc5.pdf").read_bytes()
    after = (folders / "out/doc5/doc5_layout.pdf").read_bytes()
    assert after.startswith(before)
    pdf = Pdf(after)
    drawn = pdf.get(pdf.get(pdf._pages[1][1]["Contents"])[-1]).data
    assert b"0.400 0.400 1.000 rg 0 0 150 50 re f" in drawn and b"(3) Tj" in drawn

    # a rerun asks no model for what is done, and tries what was rejected again
    for x in calls.iterdir():
        x.unlink()
    again = run()
    assert {n for n, s in again} == {"broken", "fails", "doc1"} and all(s == "rejected" for _, s in again)
    assert sum(int(x.read_text()) for x in calls.iterdir()) <= 2 * 4  # two pages, asked together and one by one
    (folders / "in/fails.pdf").write_bytes(pdfs.of_pages(1, LAYOUT))
    (folders / "in/doc3.pdf").write_bytes(pdfs.of_pages(2, LAYOUT))
    assert {n for (n, s) in run() if s == "done"} == {"fails", "doc3"}
    known = {}
    for r in sink.manifest(spark, out).collect():
        known.setdefault(r.name, set()).add(r.status)
    assert known["fails"] == {"done", "rejected"} and known["doc3"] == {"done"} and len(known) == 19


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    assert engine.parse_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), "echo").count() == 0
    assert results(tmp_path / "out") == []


def test_scans_and_pictures(spark, tmp_path):
    """A model that tells a PNG from a file of a page: scanned pages come as pictures, and pictures get their overlay."""
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    picture = pixels.encoded(np.full((40, 30, 3), 200, np.uint8))
    (tmp_path / "in/photo.png").write_bytes(picture)
    (tmp_path / "in/scan.pdf").write_bytes(scans.as_pdf(picture))
    (tmp_path / "in/typed.pdf").write_bytes(pdfs.of_pages(1, b"(words) Tj"))
    (tmp_path / "in/old.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 30, 40))

    def make():
        return lambda images, prompts: ["<box:0 0 500 500><label:text><|rotate_up|>" if "layout" in p else f"{x[:4]!r} {len(x)}" for x, p in zip(images, prompts, strict=True)]

    inference.register("telling", make)
    told = engine.parse_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), "telling", dpi=72)
    assert {r.name: r.status for r in told.collect()} == dict.fromkeys(("photo", "scan", "typed", "old"), "done")
    read = {n: (tmp_path / f"out/{n}/{n}.md").read_text() for n in ("photo", "scan", "typed")}
    assert "PNG" in read["photo"] and read["photo"] == read["scan"] and "%PDF" in read["typed"]
    assert {f.split("/")[0] for f in results(tmp_path / "out") if f.endswith("_layout.pdf")} == {"photo", "scan", "typed"}
    drawn = Pdf((tmp_path / "out/photo/photo_layout.pdf").read_bytes())
    assert drawn.size(0) == (30.0, 40.0) and b" re f" in drawn.get(drawn.get(drawn._pages[0][1]["Contents"])[-1]).data
