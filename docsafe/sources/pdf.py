"""Structure of PDF files: their check, page count, and the rotation and contents of pages. Text and images of pages are an
engine's (`operators/engines.py`).

Objects are found by reading the file from front to back, streams skipped, so that files with damaged tables are read as
well; of objects of one number the last counts. Object streams are unpacked to `MOST_UNPACKED` bytes, beyond which a file is
invalid. Files that the empty password opens are read if they are enciphered by RC4 or hold their page tree in the clear;
the check of revision 6 needs AES, which is not at hand: such files count as asking for a password.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_UNPACKED = 256 << 20
BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])|trailer(?=[\x00\t\n\x0c\r ]*<<)")
REFERENCE = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
WORD = re.compile(rb"[A-Za-z]+")
STREAM = re.compile(rb"stream(?:\r\n|\n|\r)?")
#: The padding of passwords. A fixed value of the format.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    entries: dict
    raw: bytes
    number: int
    generation: int


class Refused(Exception):
    """A file that is not read; its code is the message."""


def parsed(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """The value at a place and where it ends."""
    if depth > 100:
        raise ValueError("nested too deep")
    at = BLANK.match(data, at).end()
    two, one = data[at : at + 2], data[at : at + 1]
    if two == b"<<":
        out, at = {}, at + 2
        while True:
            at = BLANK.match(data, at).end()
            if data[at : at + 2] == b">>":
                return out, at + 2
            key, at = parsed(data, at, depth + 1)
            out[key], at = parsed(data, at, depth + 1)
    if one == b"[":
        items, at = [], at + 1
        while True:
            at = BLANK.match(data, at).end()
            if data[at : at + 1] == b"]":
                return items, at + 1
            item, at = parsed(data, at, depth + 1)
            items.append(item)
    if one == b"(":
        return _literal(data, at + 1)
    if one == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if m := NAME.match(data, at):
        return "/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[1]).decode("latin-1"), m.end()
    if m := REFERENCE.match(data, at):
        return Ref(int(m[1])), m.end()
    if m := NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    if m := WORD.match(data, at):
        return {b"true": True, b"false": False}.get(m[0]), m.end()
    raise ValueError(f"no value at {at}")


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, open_ones = bytearray(), 1
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            e = data[at + 1 : at + 2]
            out += plain.get(e, e)
            at += 2 + (e == b"\r" and data[at + 2 : at + 3] == b"\n")
            continue
        open_ones += (c == b"(") - (c == b")")
        at += 1
        if not open_ones:
            return bytes(out), at
        out += c
    raise ValueError("an open string")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class File:
    """A PDF file's objects, its trailer and, where it is enciphered, the key of the empty password."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Refused("invalid_pdf")
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        self.key: bytes | None = None
        self.cipher = "none"
        self._read(data)
        if self.trailer.get("/Encrypt") is not None:
            self._open()
        self._unpack()

    def get(self, x: Any) -> Any:
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        raise ValueError("references in a ring")

    def _read(self, data: bytes) -> None:
        at = 0
        while m := OBJECT.search(data, at):
            try:
                x, at = parsed(data, m.end())
            except (ValueError, RecursionError, TypeError):
                at = m.end()
                continue
            if m[1] is None:
                self.trailer |= x
                continue
            start = STREAM.match(data, BLANK.match(data, at).end()) if isinstance(x, dict) else None
            if start:
                n = x.get("/Length")
                end = start.end() + n if isinstance(n, int) and n >= 0 else -1
                if end < 0 or not re.compile(rb"[\r\n ]*endstream").match(data, end):
                    end = data.find(b"endstream", start.end())
                    end = len(data) if end < 0 else end
                x, at = Stream(x, data[start.end() : end], int(m[1]), int(m[2])), end
                if x.entries.get("/Type") == "/XRef":
                    self.trailer |= {k: v for k, v in x.entries.items() if k in ("/Root", "/Encrypt", "/ID")}
            self.objects.pop(int(m[1]), None)
            self.objects[int(m[1])] = x

    def _open(self) -> None:
        try:
            e = self.get(self.trailer["/Encrypt"])
            revision, user = e["/R"], self.get(e["/U"])
            if e.get("/Filter") != "/Standard" or revision not in (2, 3, 4, 5):
                raise Refused("password_required")
            if revision == 5:
                good, self.cipher = hashlib.sha256(user[32:40]).digest() == user[:32], "aes"
            else:
                good = self._legacy(e, revision, user)
        except (KeyError, TypeError, ValueError, AttributeError, IndexError) as x:
            raise Refused("password_required") from x
        if not good:
            raise Refused("password_required")

    def _legacy(self, e: dict, revision: int, user: bytes) -> bool:
        n = 5 if revision == 2 else int(e.get("/Length", 40 if e.get("/V") == 1 else 128 if e.get("/V") == 4 else 40)) // 8
        first = self.get((self.get(self.trailer.get("/ID")) or [b""])[0])
        clear = b"\xff" * 4 if revision == 4 and e.get("/EncryptMetadata") is False else b""
        key = hashlib.md5(PADDING + self.get(e["/O"])[:32] + (int(e["/P"]) & 0xFFFFFFFF).to_bytes(4, "little") + first + clear).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        method = self.get(self.get(e.get("/CF", {})).get(e.get("/StmF"), {})).get("/CFM") if e.get("/V") == 4 else "/V2"
        self.cipher = "rc4" if method == "/V2" else "none" if method in (None, "/None") else "aes"
        if revision == 2:
            return rc4(self.key, PADDING) == user[:32]
        check = hashlib.md5(PADDING + first).digest()
        for i in range(20):
            check = rc4(bytes(k ^ i for k in self.key), check)
        return check == user[:16]

    def deciphered(self, s: Stream) -> bytes:
        if self.cipher == "aes":
            raise ValueError("enciphered by AES")
        if self.cipher == "none":
            return s.raw
        key = hashlib.md5(self.key + s.number.to_bytes(4, "little")[:3] + s.generation.to_bytes(3, "little")[:2]).digest()
        return rc4(key[: min(16, len(self.key) + 5)], s.raw)

    def pieces(self, s: Stream) -> Iterator[bytes]:
        """The bytes of a stream, unpacked piece by piece."""
        filters = self.get(s.entries.get("/Filter")) or []
        filters = [self.get(x) for x in filters] if isinstance(filters, list) else [filters]
        raw = self.deciphered(s)
        if not filters:
            yield raw
        elif filters in (["/FlateDecode"], ["/Fl"]):
            z, left = zlib.decompressobj(), raw
            while left and not z.eof:
                yield z.decompress(left, 1 << 20)
                left = z.unconsumed_tail
        else:
            raise ValueError(f"packed by {filters}")

    def _unpack(self) -> None:
        left, place = MOST_UNPACKED, {k: i for i, k in enumerate(self.objects)}
        for number, s in list(self.objects.items()):
            if not (isinstance(s, Stream) and s.entries.get("/Type") == "/ObjStm"):
                continue
            data = bytearray()
            try:
                for piece in self.pieces(s):
                    data += piece
                    if len(data) > left:
                        raise Refused("invalid_pdf")
                n, first = self.get(s.entries["/N"]), self.get(s.entries["/First"])
                heads = [int(x) for x in bytes(data[:first]).split()[: 2 * n]]
                for k, offset in zip(heads[::2], heads[1::2], strict=False):
                    if place.get(k, -1) < place[number]:
                        self.objects[k], place[k] = parsed(bytes(data), first + offset)[0], place[number]
            except (KeyError, TypeError, ValueError, zlib.error):
                continue
            left -= len(data)

    def pages(self) -> Iterator[tuple[dict, int]]:
        """Pages in order with their rotation, their own or that of the nearest node above."""
        root = self.get(self.trailer.get("/Root"))
        if not isinstance(root, dict):
            root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("/Type") == "/Catalog"), {})
        todo, seen = [(root.get("/Pages"), 0)], set()
        while todo:
            ref, turn = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            turn = self.get(node.get("/Rotate", turn))
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                todo += [(k, turn) for k in reversed(kids)]
            elif node.get("/Type") != "/Pages":
                yield node, turn

    def has_content(self, page: dict) -> bool:
        """Whether any stream of a page holds more than blanks; what cannot be read is taken to."""
        try:
            contents = self.get(page.get("/Contents"))
            for x in contents if isinstance(contents, list) else [] if contents is None else [contents]:
                if any(piece.strip(b"\x00\t\n\x0b\x0c\r ") for piece in self.pieces(self.get(x))):
                    return True
            return False
        except Exception:
            return True


def structure(data: bytes | None, most_pages: int) -> tuple[int, str | None, list[dict]]:
    """(pages, error code, rotation and content of each page) of a file."""
    try:
        file = File(data or b"")
        pages = list(file.pages())
    except Refused as e:
        return 0, str(e), []
    except Exception:
        return 0, "invalid_pdf", []
    if not pages:
        return 0, "invalid_pdf", []
    if len(pages) > most_pages:
        return len(pages), "too_many_pages", []
    return len(pages), None, [{"rotation": int(t) % 360 if isinstance(t, (int, float)) else 0, "has_content": file.has_content(p)} for p, t in pages]


TYPE = "struct<page_count:int,error_code:string,pages:array<struct<rotation:int,has_content:boolean>>>"


def documents(files: DataFrame, most_bytes: int = 2 << 30, most_pages: int = 5000) -> DataFrame:
    """files (with length, content) and page_count, error_code, pages in place of the content. Size is judged first, without
    reading the content, then structure, password, and the number of pages. A null content is an invalid file."""

    @F.pandas_udf(TYPE)
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([structure(x, most_pages) for x in content], columns=["page_count", "error_code", "pages"])

    small = F.coalesce(F.col("length") <= most_bytes, F.lit(True))
    out = files.withColumn("_s", read(F.when(small, F.col("content"))))
    return out.drop("content").select(
        "*", F.when(small, F.col("_s.page_count")).otherwise(0).alias("page_count"), F.when(small, F.col("_s.error_code")).otherwise("pdf_too_large").alias("error_code"),
        F.when(small, F.col("_s.pages")).otherwise(F.array().cast("array<struct<rotation:int,has_content:boolean>>")).alias("pages"),
    ).drop("_s")


def pages(read: DataFrame) -> DataFrame:
    """A row a page of `documents`: page_index, rotation, has_content; files with an error have none."""
    return read.select("*", F.posexplode("pages").alias("page_index", "_p")).select("*", "_p.rotation", "_p.has_content").drop("pages", "_p")
