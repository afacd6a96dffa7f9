"""Texts of PDF pages by the standard library: objects, flate streams, the order of pages, and text operators.

Files come as rows of ``files.binary_files``, so from any store that Spark reads; each is read where its bytes lie, and a file
that can't be read gives one row without text. Strings are decoded by the font's ToUnicode map where there is one, else as
Latin-1. Encrypted files and images of text are beyond this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of the .pdf rows of ``binary_files``; pages count from 1."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, n, t) for n, t in enumerate(pages(bytes(content)), 1)] or [(path, 1, None)]
                except Exception:  # whatever is wrong inside a file, the others are read
                    rows.append((path, 1, None))
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.filter("extension = 'pdf'").select("path", "content").mapInPandas(run, "path string, page int, text string")


def objects(data: bytes) -> dict[int, bytes]:
    """Number -> body of the objects of a file, those packed in object streams too; a later one replaces an earlier."""
    import re

    out = {int(m[1]): m[2] for m in re.finditer(rb"(?<![0-9])([0-9]+)[ ]+[0-9]+[ ]+obj\b(.*?)\bendobj", data, re.S)}
    for body in list(out.values()):
        if b"/ObjStm" in body[:300]:
            flat = stream(body)
            n, first = (int(re.search(rb"/" + k + rb"\s+([0-9]+)", body)[1]) for k in (b"N", b"First"))
            head = list(map(int, flat[:first].split()[: 2 * n]))
            ends = [*head[3::2], len(flat) - first]
            for number, a, b in zip(head[::2], head[1::2], ends):
                out.setdefault(number, flat[first + a : first + b])
    return out


def stream(body: bytes) -> bytes:
    """The bytes of an object's stream, inflated if they are packed so."""
    import re
    import zlib

    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]


def _refs(body: bytes, key: bytes) -> list[int]:
    """The numbers of the objects that an entry refers to, one or a list."""
    import re

    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|[0-9]+\s+[0-9]+\s+R)", body)
    return [int(x) for x in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", m[1])] if m else []


def pages(data: bytes) -> list[str]:
    """The text of each page in the order of the page tree."""
    import re

    known = objects(data)
    kind = lambda body, name: re.search(rb"/Type\s*/" + name + rb"\b", body) is not None
    roots = [b for b in known.values() if kind(b, b"Catalog")]
    order, todo = [], [n for b in roots for n in reversed(_refs(b, b"Pages"))]
    seen: set[int] = set()
    while todo:
        n = todo.pop()
        if n in seen or n not in known:
            continue
        seen.add(n)
        if kind(known[n], b"Pages"):
            todo += reversed(_refs(known[n], b"Kids"))
        elif kind(known[n], b"Page"):
            order.append(n)
    order = order or sorted(n for n, b in known.items() if kind(b, b"Page"))
    out = []
    for n in order:
        fonts = _fonts(known, known[n])
        out.append(_shown(b"\n".join(stream(known[c]) for c in _refs(known[n], b"Contents") if c in known), fonts))
    return out


def _fonts(known: dict[int, bytes], page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
    """Name -> (bytes of a code, code -> text) of the page's fonts that have a ToUnicode map."""
    import re

    own = page + b"".join(known.get(n, b"") for n in _refs(page, b"Resources"))
    own += b"".join(known.get(n, b"") for n in _refs(own, b"Font"))
    out = {}
    for name, n in re.findall(rb"/([A-Za-z0-9_.+-]+)\s+([0-9]+)\s+[0-9]+\s+R", own):
        for m in _refs(known.get(int(n), b""), b"ToUnicode"):
            table, text = {}, stream(known.get(m, b""))
            put = lambda code, to: table.__setitem__(code, bytes.fromhex(to.decode()).decode("utf-16-be", "replace"))  # noqa: E731,B023
            sizes = [len(x) // 2 for x in re.findall(rb"<([0-9A-Fa-f]+)>", b" ".join(re.findall(rb"begincodespacerange(.*?)endcodespacerange", text, re.S)))]
            for part in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
                for a, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    put(int(a, 16), to)
            for part in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
                for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    for k in range(min(int(b, 16) - int(a, 16), 65535) + 1):
                        put(int(a, 16) + k, b"%0*x" % (len(to), int(to, 16) + k))
            out[name] = (max(sizes, default=1), table)
    return out


def _string(token: bytes) -> bytes:
    """The bytes of a string in parentheses or of hexadecimal digits."""
    import re

    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else plain.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", one, token[1:-1])


def _shown(content: bytes, fonts: dict) -> str:
    """What the text operators of a page show: moves to another line begin a line, wide gaps are spaces."""
    import re

    token = re.compile(rb"\((?:[^()\\]|\\[\s\S]|\((?:[^()\\]|\\[\s\S])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+")
    out, held, font = [], [], (1, None)

    def text(raw: bytes) -> str:
        size, table = font
        if table is None:
            return raw.decode("latin-1")
        return "".join(table.get(int.from_bytes(raw[k : k + size], "big"), "") for k in range(0, len(raw), size))

    for t in token.findall(content):
        if t[:1] in b"(<" or t in (b"[", b"]") or t[:1] == b"/" or re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", t):
            held.append(t)
            continue
        if t == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2][1:], (1, None))
        elif t in (b"T*", b"Tm", b"ET") or t in (b"Td", b"TD") and len(held) > 1 and float(held[-1]):
            out.append("\n")
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(text(_string(x)))
                elif t == b"TJ" and x not in (b"[", b"]") and float(x) < -200:
                    out.append(" ")
        held = []
    lines = [x.strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x)
