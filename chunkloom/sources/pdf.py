"""PDF to pages of text: a small reader of our own, or pypdfium2 where that is asked for.

The own reader knows Flate and plain streams, object streams, the page tree, text operators and
ToUnicode maps: enough for text PDFs. Encrypted files, other filters, and codes that no map gives a
text for are errors, not empty text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_LEXEME = re.compile(rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\](){}/%]*|<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R\b|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9]?|.", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Operator(bytes):
    pass


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """The literal string whose opening parenthesis is at at - 1, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            c = raw[at : at + 1]
            at += 1
            octal = re.compile(rb"[0-7]{1,3}").match(raw, at - 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif c == b"\r":
                at += raw[at : at + 1] == b"\n"
            elif c != b"\n":
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def parse(raw: bytes) -> Iterator[object]:
    """Objects and operators of a body, in order; arrays are lists, dictionaries dicts."""
    at, stack = 0, [[]]
    while at < len(raw):
        if raw[at : at + 1] == b"(":
            value, at = _string(raw, at + 1)
            stack[-1].append(value)
        else:
            found = _LEXEME.match(raw, at)
            word, at = found[0], found.end()
            if word.isspace() or word.startswith(b"%"):
                continue
            if word in (b"<<", b"["):
                stack.append([])
                continue
            if word in (b">>", b"]") and len(stack) > 1:
                items = stack.pop()
                stack[-1].append(items if word == b"]" else dict(zip(items[::2], items[1::2])))
            elif word.startswith(b"/"):
                stack[-1].append(Name(word[1:].decode("latin-1")))
            elif word.startswith(b"<"):
                digits = re.sub(rb"\s", b"", word[1:-1])
                stack[-1].append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            elif word.endswith(b"R") and word[:1].isdigit():
                stack[-1].append(Ref(word.split()[0]))
            elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", word):
                stack[-1].append(float(word))
            else:
                stack[-1].append(Operator(word))
        if len(stack) == 1:
            yield from stack[0]
            stack[0] = []
    yield from stack[0]


class Reader:
    def __init__(self, raw: bytes) -> None:
        if not raw.startswith(b"%PDF") and b"%PDF" not in raw[:1024]:
            raise ValueError("not a PDF")
        if b"/Encrypt" in raw:
            raise ValueError("encrypted PDF")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for number, _, body in _OBJECT.findall(raw):
            head, mark, rest = body.partition(b"stream")
            value = next(iter(parse(head)), None)
            self.objects[int(number)] = (value, re.sub(rb"^\r?\n", b"", rest).rpartition(b"endstream")[0] if mark and isinstance(value, dict) else None)
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                data, first = self.decoded(value, stream), int(self.of(value["First"]))
                numbers = [int(x) for x in parse(data[:first])]
                for number, start in zip(numbers[::2], numbers[1::2]):
                    self.objects.setdefault(number, (next(iter(parse(data[first + start :])), None), None))

    def of(self, value: object) -> object:
        return self.objects.get(int(value), (None, None))[0] if isinstance(value, Ref) else value

    def decoded(self, head: dict, stream: bytes) -> bytes:
        filters = self.of(head.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode":
                raise ValueError(f"PDF filter {name}")
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def pages(self) -> list[dict]:
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []
        queue = [(self.of(root.get("Pages")), {}) for root in roots[-1:]]
        seen: set[int] = set()
        while queue:
            node, inherited = queue.pop(0)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = self.of(node.get("Resources")) or inherited
            if "Kids" in node:
                queue = [(self.of(kid), resources) for kid in self.of(node["Kids"]) or []] + queue
            else:
                out.append({"contents": node.get("Contents"), "resources": resources})
        return out

    def stream(self, ref: object) -> bytes:
        value, raw = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        return self.decoded(value, raw) if isinstance(value, dict) and raw is not None else b""

    def unicode_map(self, font: object) -> tuple[dict[bytes, str], int] | None:
        """Texts of a font's codes, and how many bytes a code has; None for a simple font without a map."""
        font = self.of(font)
        raw = self.stream(font["ToUnicode"]) if isinstance(font, dict) and "ToUnicode" in font else b""
        if not raw:
            if isinstance(font, dict) and font.get("Subtype") == "Type0":
                raise ValueError("composite font without a ToUnicode map")
            return None
        out: dict[bytes, str] = {}
        held: list[object] = []
        width = 1
        for item in parse(raw):
            if not isinstance(item, Operator):
                held.append(item)
                continue
            if item == b"endbfchar":
                for code, text in zip(held[::2], held[1::2]):
                    out[code] = text.decode("utf-16-be", "replace")
                    width = max(width, len(code))
            elif item == b"endbfrange":
                for low, high, text in zip(held[::3], held[1::3], held[2::3]):
                    width = max(width, len(low))
                    for k in range(int.from_bytes(low) if low else 0, int.from_bytes(high) + 1):
                        step = k - int.from_bytes(low)
                        made = text[step] if isinstance(text, list) else (int.from_bytes(text) + step).to_bytes(len(text))
                        out[k.to_bytes(len(low))] = made.decode("utf-16-be", "replace")
            held = []
        return out, width

    def text(self, page: dict) -> tuple[str, int]:
        """The page's text, lines separated by line feeds, and how many images that are not empty it draws."""
        contents = page["contents"]
        inner = self.of(contents)
        refs = inner if isinstance(inner, list) else [contents]
        resources = page["resources"]
        fonts = self.of(resources.get("Font")) or {}
        drawn = self.of(resources.get("XObject")) or {}
        maps: dict[str, tuple[dict[bytes, str], int] | None] = {}
        out: list[str] = []
        held: list[object] = []
        now: tuple[dict[bytes, str], int] | None = None
        images = 0
        due = gap = False  # a line ends, or the pen has moved along it, before the next text

        def decoded(raw: bytes) -> str:
            if now is None:
                return raw.decode("cp1252", "replace")
            texts, width = now
            codes = [raw[i : i + width] for i in range(0, len(raw), width)]
            if lost := [c.hex() for c in codes if c not in texts]:
                raise ValueError(f"no text for code {lost[0]}")
            return "".join(texts[c] for c in codes)

        def show(raw: object) -> None:
            nonlocal due, gap
            if not isinstance(raw, bytes):
                return
            text = decoded(raw)
            if due:
                out.append("\n")
            elif gap and out and out[-1] and text and not out[-1][-1].isspace() and not text[0].isspace() and text[0] not in ",.;:!?)]":
                out.append(" ")
            due = gap = False
            out.append(text)

        def line() -> None:
            nonlocal due
            due = due or bool(out)

        for item in parse(b"\n".join(self.stream(r) for r in refs)):
            if not isinstance(item, Operator):
                held.append(item)
                continue
            if item == b"Tf" and len(held) >= 2:
                name = str(held[-2])
                if name not in maps:
                    maps[name] = self.unicode_map(fonts.get(name))
                now = maps[name]
            elif item in (b"T*", b"Tm", b"ET") or (item in (b"Td", b"TD") and held and held[-1] != 0):
                line()
            elif item in (b"Td", b"TD"):
                gap = True
            elif item in (b"Tj", b"'", b'"') and held:
                if item != b"Tj":
                    line()
                show(held[-1])
            elif item == b"TJ" and held and isinstance(held[-1], list):
                for part in held[-1]:
                    if isinstance(part, float):
                        if part < -200:
                            out.append(" ")
                    else:
                        show(part)
            elif item == b"Do" and held:
                target, stored = self.objects.get(int(drawn[held[-1]]), (None, None)) if isinstance(drawn.get(held[-1]), Ref) else (None, None)
                images += isinstance(target, dict) and target.get("Subtype") == "Image" and bool(stored and stored.strip(b"\r\n"))
            held = []
        return "".join(out), images


def pages(content: bytes, engine: str = "own") -> Iterator[tuple[str, int] | Exception]:
    """(text, images) of each page, in order, or what went wrong with it. engine: "own" or "pdfium".

    The engine is the caller's choice and never depends on what a worker has installed.
    """
    if engine not in ("own", "pdfium"):
        raise ValueError(f"no PDF engine {engine}")
    if engine == "own":
        reader = Reader(content)
        for page in reader.pages():
            try:
                yield reader.text(page)
            except Exception as problem:  # isolates a broken page from its file
                yield problem
        return
    import pypdfium2

    document = pypdfium2.PdfDocument(content, autoclose=True)
    try:
        for i in range(len(document)):
            try:
                page = document[i]
                body = page.get_textpage()
                yield body.get_text_range(), sum(1 for o in page.get_objects() if o.type == 3)
                body.close()
                page.close()
            except Exception as problem:
                yield problem
    finally:
        document.close()


def build(texts: list[str]) -> bytes:
    """A minimal PDF with a page for each Latin-1 text, for fixtures."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(texts))), len(texts))]
    for i, text in enumerate(texts):
        shown = b"".join(b"(%s) Tj T*\n" % re.sub(rb"([\\()])", rb"\\\1", part.encode("cp1252")) for part in text.split("\n"))
        stream = zlib.compress(b"BT /F1 12 Tf 14 TL 72 720 Td\n" + shown + b"ET")
        bodies += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, b) for k, b in enumerate(bodies)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
