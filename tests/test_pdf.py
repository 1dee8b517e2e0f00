"""PDF structure on files made here: object streams, ciphers, inherited rotations, damage."""

import hashlib
import random
import zlib

from docsafe.sources import pdf


def made(pages, rotate=None, tail=b"", objects=(), head=b"%PDF-1.7\n"):
    """A file of (content or None, rotation or None) pages."""
    out = [b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out.append(b"2 0 obj\n<< /Type /Pages /Kids [%s] /Count %d %s >>\nendobj" % (kids, len(pages), b"/Rotate %d" % rotate if rotate is not None else b""))
    for i, (content, turn) in enumerate(pages):
        n = 10 + 2 * i
        has = b"/Contents %d 0 R" % (n + 1) if content is not None else b""
        out.append(b"%d 0 obj <</Type/Page /Parent 2 0 R %s %s>> endobj" % (n, has, b"/Rotate %d" % turn if turn is not None else b""))
        if content is not None:
            z = zlib.compress(content)
            out.append(b"%d 0 obj <</Length %d /Filter /FlateDecode>> stream\n%s\nendstream endobj" % (n + 1, len(z), z))
    return head + b"\n".join([*out, *objects]) + b"\ntrailer <</Root 1 0 R %s>>\n%%%%EOF" % tail


def test_pages():
    n, error, pages = pdf.structure(made([(b"BT ET", None), (None, 0), (b"  \n", -90), (b"x", 450)], rotate=90), 10)
    assert (n, error) == (4, None)
    assert [(p["rotation"], p["has_content"]) for p in pages] == [(90, True), (0, False), (270, False), (90, True)]


def test_errors():
    for data in (None, b"", b"hello", b"%PDF-1.4\nnothing", made([])):
        assert pdf.structure(data, 10)[:2] == (0, "invalid_pdf")
    assert pdf.structure(made([(b"x", None)] * 11), 10)[:2] == (11, "too_many_pages")
    ring = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids [2 0 R 3 0 R]>> endobj 3 0 obj <</Type/Page>> endobj"
    assert pdf.structure(ring, 10)[:2] == (1, None)  # no trailer, and a node that is its own child
    unknown = made([(b"x", None)]).replace(b"/FlateDecode", b"/LZWDecode__")
    assert pdf.structure(unknown, 10)[2][0]["has_content"]


def packed(numbered):
    """Objects (number, bytes) in an object stream."""
    heads, body = [], b""
    for k, x in numbered:
        heads.append(b"%d %d" % (k, len(body)))
        body += x + b" "
    head = b" ".join(heads) + b" "
    return head + body, len(numbered), len(head)


def test_object_streams():
    data, n, first = packed([(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R 4 0 R]/Rotate 180>>"), (3, b"<</Type/Page>>"), (4, b"<</Type/Page/Contents[5 0 R]>>")])
    z = zlib.compress(data)
    file = b"%%PDF-1.5\n5 0 obj <</Length 1>> stream\nq\nendstream endobj\n7 0 obj <</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>> stream\r\n%s\nendstream endobj\n8 0 obj <</Type/XRef/Root 1 0 R/Length 0>> stream\n\nendstream endobj" % (n, first, len(z), z)
    assert pdf.structure(file, 10) == (2, None, [{"rotation": 180, "has_content": False}, {"rotation": 180, "has_content": True}])
    later = file + b"\n3 0 obj <</Type/Page/Rotate 90>> endobj"  # an update counts, wherever the old one lies
    assert [p["rotation"] for p in pdf.structure(later, 10)[2]] == [90, 180]
    data, n, first = packed([(4, b"<</Type/Page/Rotate 270>>")])
    again = later + b"\n9 0 obj <</Type/ObjStm/N %d/First %d/Length %d>> stream\n%s\nendstream endobj" % (n, first, len(data), data)
    assert pdf.structure(again, 10)[2] == [{"rotation": 90, "has_content": False}, {"rotation": 270, "has_content": False}]


def enciphered(password, revision=3):
    """A file whose user password is given, by RC4 of 40 or 128 bits."""
    owner, ident, rights, n = b"o" * 32, b"i" * 16, -44, 5 if revision == 2 else 16
    padded = (password + pdf.PADDING)[:32]
    key = hashlib.md5(padded + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    if revision == 2:
        user = pdf.rc4(key, pdf.PADDING)
    else:
        user = hashlib.md5(pdf.PADDING + ident).digest()
        for i in range(20):
            user = pdf.rc4(bytes(k ^ i for k in key), user)
        user += b"\0" * 16
    own = hashlib.md5(key + (11).to_bytes(3, "little") + b"\0\0").digest()[: min(16, n + 5)]
    blank = pdf.rc4(own, b" \n ")
    content = b"11 0 obj <</Length %d>> stream\n%s\nendstream endobj" % (len(blank), blank)
    page = b"10 0 obj <</Type/Page/Contents 11 0 R>> endobj"
    tail = b"/ID [<%s> <%s>] /Encrypt <</Filter/Standard/V %d/R %d/Length %d/P %d/O <%s>/U <%s>>>" % (ident.hex().encode(), ident.hex().encode(), 1 if revision == 2 else 2, revision, 8 * n, rights, owner.hex().encode(), user.hex().encode())
    return made([(None, None)], tail=tail, objects=[page, content])


def test_passwords():
    for revision in (2, 3):
        assert pdf.structure(enciphered(b"", revision), 10) == (1, None, [{"rotation": 0, "has_content": False}])
        assert pdf.structure(enciphered(b"secret", revision), 10)[:2] == (0, "password_required")
    salt = b"saltsalt"
    five = lambda p: made([(b"x", None)], tail=b"/Encrypt <</Filter/Standard/V 5/R 5/U <%s>>>" % (hashlib.sha256(p + salt).digest() + salt + b"\0" * 8).hex().encode())
    assert pdf.structure(five(b""), 10)[:2] == (1, None) and pdf.structure(five(b"x"), 10)[1] == "password_required"
    assert pdf.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_values():
    got = pdf.parsed(rb"<</A (a\(b\)\101\n(c)) /B#20C [1 -2.5 true null 3 0 R <4142 4>] % note" + b"\n/D <</E/F>>>>", 0)[0]
    assert got == {"/A": b"a(b)A\n(c)", "/B C": [1, -2.5, True, None, pdf.Ref(3), b"AB@"], "/D": {"/E": "/F"}}


def test_damage_never_raises():
    r, file = random.Random(3), made([(b"BT", 90)] * 3, rotate=0)
    for _ in range(300):
        x = bytearray(file)
        for _ in range(r.randint(1, 12)):
            x[r.randrange(len(x))] = r.randrange(256)
        n, error, pages = pdf.structure(bytes(x[: r.randint(1, len(x))]), 10)
        assert (error is None) == (len(pages) > 0)


def test_documents(spark):
    rows = [("a", made([(b"x", 90), (None, None)])), ("b", b"no"), ("c", None), ("d", made([(b"x" * 9000, None)]) + b" " * 9000), ("e", made([(b"x", None)] * 4))]
    df = spark.createDataFrame([(p, len(x) if x is not None else None, x) for p, x in rows], "path string, length long, content binary")
    read = pdf.documents(df, 5000, 3)
    got = {r["path"]: (r["page_count"], r["error_code"]) for r in read.collect()}
    assert got == {"a": (2, None), "b": (0, "invalid_pdf"), "c": (0, "invalid_pdf"), "d": (0, "pdf_too_large"), "e": (4, "too_many_pages")}
    assert [tuple(r) for r in pdf.pages(read).select("path", "page_index", "rotation", "has_content").orderBy("page_index").collect()] == [("a", 0, 90, True), ("a", 1, 0, False)]
    assert pdf.pages(pdf.documents(df.limit(0))).count() == 0
