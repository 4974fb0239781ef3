"""Hand-made PDF files."""

import zlib

TREE = {
    1: b"<</Type /Catalog /Pages 2 0 R>>",
    2: b"<</Type/Pages/Count 3/Kids[3 0 R 4 0 R]/MediaBox[0 0 200 100]/Rotate 90/Resources<</Font<</F 9 0 R>>>>>>",
    3: b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>",
    4: b"<</Type/Pages/Parent 2 0 R/Count 2/Kids[5 0 R 6 0 R]/Rotate 0 >>",
    5: b"<</Type/Page/Parent 4 0 R/MediaBox[0 0 50 60.5]/CropBox [10 10 400 30]>>",
    6: b"<</Type/Page/Parent 4 0 R/Annots[<</Dest[5 0 R /Fit]>>]>>",
    7: b"<</Length 8 0 R>>stream\nBT (a\\)b) ET\nendstream",
    8: b"12",
    9: b"<</Type/Font/BaseFont/Times#20Roman /X (\\101\\\n(in)) /Y <4>>>",
}
SIZES = [(100.0, 200.0), (40.0, 20.0), (200.0, 100.0)]


def with_table(objects=TREE, extra=b"", shift=0):
    body, at = bytearray(b"%PDF-1.4\n"), {}
    for n, x in objects.items():
        at[n] = len(body) + shift
        body += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    start = len(body)
    body += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in at.items())
    return bytes(body + b"trailer <</Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF" % (max(objects) + 1, extra, start))


def with_streams(objects=TREE, predictor=True):
    """Dictionaries in an object stream, the table as a stream with differences of rows."""
    inner = {n: x for n, x in objects.items() if b"stream" not in x}
    heads, bodies = [], b""
    for n, x in inner.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += x + b"\n"
    head = b" ".join(heads) + b"\n"
    packed = zlib.compress(head + bodies)
    number = max(objects) + 1
    body, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 0)}
    for n, x in objects.items():
        if n not in inner:
            rows[n] = (1, len(body), 0)
            body += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    rows |= {n: (2, number, k) for k, n in enumerate(inner)}
    rows[number] = (1, len(body), 0)
    body += b"%d 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\r\n" % (number, len(inner), len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    start = len(body)
    rows[number + 1] = (1, start, 0)
    flat = [bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, (k, a, b) in sorted(rows.items())]
    if predictor:
        before, out = bytes(7), b""
        for row in flat:
            out += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
            before = row
    data = zlib.compress(out if predictor else b"".join(flat))
    params = b"/DecodeParms<</Predictor 12/Columns 7>>" if predictor else b""
    body += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 2]/Root 1 0 R/Filter/FlateDecode%s/Length %d>>stream\n" % (number + 1, number + 2, params, len(data)) + data + b"\nendstream\nendobj\n"
    return bytes(body + b"startxref\n%d\n%%%%EOF\n" % start)


def of_pages(n, text=b""):
    """A file of n pages of growing size, with a text in the contents of each."""
    kids = b" ".join(b"%d 0 R" % (3 + i) for i in range(n))
    objects = {1: TREE[1], 2: b"<</Type/Pages/Count %d/Kids[%s]>>" % (n, kids)}
    for i in range(n):
        objects[3 + i] = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d 500]/Contents %d 0 R>>" % (300 + i, 3 + n + i)
    for i in range(n):
        content = text + b" %d" % i
        objects[3 + n + i] = b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content)
    return with_table(objects)
