"""A small reader of PDF text: pages, positioned spans with font and size, and blocks of lines.

It reads what most text PDFs hold: objects in the file or in object streams, plain or Flate streams, simple
fonts in Latin encodings and composite fonts with a ToUnicode map. Encrypted files are refused; pictures are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Flags of a span as extracted: italic, serif, monospaced, bold.
ITALIC, MONO, BOLD = 2, 8, 16
#: Lines belong to one block if their distance is below so many font sizes.
LEADING = 1.6


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    """A PDF name."""


@dataclass
class Stream:
    entries: dict
    raw: bytes

    def data(self, pdf: Pdf) -> bytes:
        kinds = pdf.at(self.entries.get("Filter")) or []
        out = self.raw
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind != "FlateDecode":
                raise ValueError(f"a stream is packed by {kind}")
            out = zlib.decompressobj().decompress(out)
        return _unpredicted(out, pdf.at(self.entries.get("DecodeParms")) or {})


def _unpredicted(data: bytes, how: dict) -> bytes:
    """Rows of a stream that a PNG predictor of kind none or up was applied to."""
    if not isinstance(how, dict) or how.get("Predictor", 1) < 10:
        return data
    width, out, before = how.get("Columns", 1), [], bytes(how.get("Columns", 1))
    for at in range(0, len(data), width + 1):
        kind, row = data[at], data[at + 1 : at + 1 + width]
        if kind not in (0, 2):
            raise ValueError("a predictor that is not read")
        before = bytes((a + b) & 255 for a, b in zip(row, before, strict=False)) if kind == 2 else row
        out.append(before)
    return b"".join(out)


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose text starts at ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
                continue
            at += 1
            if c in b"\r\n":
                continue
            out += ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _value(word: bytes):
    if re.fullmatch(rb"[+-]?\d+", word):
        return int(word)
    if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
        return float(word)
    return {b"true": True, b"false": False, b"null": None}.get(word, word.decode("latin-1"))


def items(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators (plain ``str``) of a piece of a PDF, with where each ends."""
    stack: list[list] = []

    def add(value, end):
        if stack:
            stack[-1].append(value)
            return None
        return value, end

    while match := TOKEN.search(data, at):
        word, at = match[0], match.end()
        if word[:1] == b"%":
            continue
        if word in (b"<<", b"["):
            stack.append([])
            continue
        if word in (b">>", b"]"):
            if not stack:
                return
            whole = stack.pop()
            refs: list = []
            for x in whole:
                if x == "R" and not isinstance(x, Name) and len(refs) >= 2:
                    refs[-2:] = [Ref(refs[-2])]
                else:
                    refs.append(x)
            value = refs if word == b"]" else {str(k): v for k, v in zip(refs[::2], refs[1::2], strict=False)}
        elif word == b"(":
            value, at = _string(data, at)
        elif word[:1] == b"<":
            digits = re.sub(rb"\s", b"", word[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif word[:1] == b"/":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), word[1:].decode("latin-1")))
        else:
            value = _value(word)
        if out := add(value, at):
            yield out


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, object] = {}
        packed = []
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            value, end = next(items(data, m.end()), (None, m.end()))
            if isinstance(value, dict) and (s := re.match(rb"\s*stream\r?\n", data[end : end + 40])):
                begin = end + s.end()
                stop = data.find(b"endstream", begin)
                length = value.get("Length")
                raw = data[begin : begin + length] if isinstance(length, int) and begin + length <= stop else data[begin:stop]
                value = Stream(value, raw)
                if value.entries.get("Type") == "ObjStm":
                    packed.append(value)
            self.objects[int(m[1])] = value
        for stream in packed:
            raw, first = stream.data(self), self.at(stream.entries["First"])
            numbers = [v for v, _ in items(raw[:first])]
            for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                self.objects.setdefault(number, next(items(raw, first + offset), (None, 0))[0])

    def at(self, value):
        """What a reference stands for."""
        return self.objects.get(value.number) if isinstance(value, Ref) else value

    def pages(self) -> list[dict]:
        root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if root is None:
            return []
        out: list[dict] = []
        todo = [(self.at(root["Pages"]), {})]
        while todo:
            node, given = todo.pop()
            if not isinstance(node, dict):
                continue
            own = given | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(self.at(k), own) for k in reversed(self.at(node["Kids"]))]
            else:
                out.append(own | node)
        return out


@dataclass
class Font:
    name: str = ""
    wide: bool = False
    codes: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    usual: float = 500.0

    @classmethod
    def of(cls, pdf: Pdf, entries: dict) -> Font:
        out = cls(str(pdf.at(entries.get("BaseFont")) or "").rpartition("+")[2], entries.get("Subtype") == "Type0")
        if out.wide:
            below = pdf.at((pdf.at(entries.get("DescendantFonts")) or [{}])[0]) or {}
            out.usual = float(pdf.at(below.get("DW")) or 1000)
        else:
            low = pdf.at(entries.get("FirstChar")) or 0
            out.widths = {low + i: float(pdf.at(w) or 0) for i, w in enumerate(pdf.at(entries.get("Widths")) or [])}
        mapping = pdf.at(entries.get("ToUnicode"))
        if isinstance(mapping, Stream):
            out.codes = _unicode_map(mapping.data(pdf))
        return out

    def read(self, raw: bytes) -> tuple[str, float, int]:
        """The text of a shown string, its width in thousandths of the size, and its characters."""
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.wide else list(raw)
        plain = "" if self.wide else None
        text = "".join(self.codes.get(c, bytes([c]).decode("cp1252", "replace") if plain is None else plain) for c in codes)
        return text, sum(self.widths.get(c, self.usual) for c in codes), len(codes)

    def flags(self) -> int:
        low = self.name.lower()
        marks = ((ITALIC, ("italic", "oblique")), (MONO, ("mono", "courier", "consol")), (BOLD, ("bold", "black", "heavy")))
        return sum(bit for bit, words in marks if any(w in low for w in words))


def _unicode_map(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda raw: raw.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end", data, re.S):
        values = [v for v, _ in items(body)]
        if kind == b"bfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(values[::2], values[1::2], strict=False)}
            continue
        for low, high, to in zip(values[::3], values[1::3], values[2::3], strict=False):
            first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            for i, code in enumerate(range(first, last + 1)):
                if isinstance(to, list):
                    out[code] = text(to[i]) if i < len(to) else ""
                else:
                    out[code] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + i).to_bytes(2, "big"))
    return out


@dataclass
class Span:
    text: str
    font: str
    size: float
    flags: int
    x: float
    y: float
    end: float


def _times(a: tuple, b: tuple) -> tuple:
    """The matrix that does ``a`` first and ``b`` next."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def spans(pdf: Pdf, page: dict) -> list[Span]:
    """The shown strings of a page in order of the file; y grows downwards from the page's top."""
    box = [float(pdf.at(x)) for x in (pdf.at(page.get("MediaBox")) or [0, 0, 612, 792])]
    given = pdf.at((pdf.at(page.get("Resources")) or {}).get("Font")) or {}
    fonts = {name: Font.of(pdf, pdf.at(f)) for name, f in given.items() if isinstance(pdf.at(f), dict)}
    content = pdf.at(page.get("Contents"))
    streams = [pdf.at(x) for x in content] if isinstance(content, list) else [content]
    data = b"\n".join(s.data(pdf) for s in streams if isinstance(s, Stream))
    out: list[Span] = []
    area, areas = SAME, []
    line = text = SAME
    font, size, leading, between, after, stretch, rise = Font(), 12.0, 0.0, 0.0, 0.0, 1.0, 0.0
    args: list = []

    def show(raw: bytes) -> None:
        nonlocal text
        shown, width, n = font.read(raw)
        place = _times(text, area)
        long = (width / 1000 * size + n * between + raw.count(b" ") * after * (not font.wide)) * stretch
        scale = (place[2] ** 2 + place[3] ** 2) ** 0.5
        reach = long * (place[0] ** 2 + place[1] ** 2) ** 0.5
        if shown.strip():
            out.append(Span(shown, font.name, round(size * scale, 2), font.flags(), place[4] - box[0], box[3] - place[5] - rise * scale, place[4] - box[0] + reach))
        text = _times((1, 0, 0, 1, long, 0), text)

    def next_line(x: float, y: float) -> None:
        nonlocal line, text
        line = text = _times((1, 0, 0, 1, x, y), line)

    for item, _ in items(data):
        if isinstance(item, Name) or not isinstance(item, str):
            args.append(item)
            continue
        numbers = [float(x) for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
        strings = [x for x in args if isinstance(x, bytes)]
        if item == "q":
            areas.append(area)
        elif item == "Q" and areas:
            area = areas.pop()
        elif item == "cm" and len(numbers) == 6:
            area = _times(tuple(numbers), area)
        elif item == "BT":
            line = text = SAME
        elif item == "Tf" and args and numbers:
            font, size = fonts.get(str(args[0]), Font()), numbers[-1]
        elif item in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if item == "TD" else leading
            next_line(*numbers)
        elif item == "Tm" and len(numbers) == 6:
            line = text = tuple(numbers)
        elif item == "T*":
            next_line(0, -leading)
        elif item == "Tj" and strings:
            show(strings[0])
        elif item in ("'", '"') and strings:
            if item == '"' and len(numbers) == 2:
                after, between = numbers
            next_line(0, -leading)
            show(strings[0])
        elif item == "TJ" and args and isinstance(args[0], list):
            for part in args[0]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, (int, float)):
                    text = _times((1, 0, 0, 1, -part / 1000 * size * stretch, 0), text)
        elif numbers and item in ("TL", "Tc", "Tw", "Tz", "Ts"):
            value = numbers[-1]
            leading = value if item == "TL" else leading
            between = value if item == "Tc" else between
            after = value if item == "Tw" else after
            stretch = value / 100 if item == "Tz" else stretch
            rise = value if item == "Ts" else rise
        args = []
    return out


def _lines(found: list[Span]) -> list[list[Span]]:
    """Spans of one height next to each other as lines; strings that touch become one span."""
    out: list[list[Span]] = []
    for s in found:
        last = out[-1][-1] if out else None
        if last is None or abs(last.y - s.y) > 0.3 * max(s.size, 1) or s.x < last.x or s.x - last.end > 3 * s.size:
            out.append([s])
        elif s.x - last.end < 0.15 * s.size and (s.font, s.size) == (last.font, last.size):
            out[-1][-1] = Span(last.text + s.text, s.font, s.size, s.flags, last.x, last.y, s.end)
        else:
            out[-1].append(s)
    return out


def _blocks(lines: list[list[Span]]) -> list[list[list[Span]]]:
    """Lines under each other, near and of one size, as blocks."""
    out: list[list[list[Span]]] = []
    for line in lines:
        if out:
            last, s = out[-1][-1][0], line[0]
            if 0 < s.y - last.y < LEADING * max(s.size, last.size) and abs(s.size - last.size) < 0.6 and s.flags == last.flags and abs(s.x - last.x) < 4 * s.size:
                out[-1].append(line)
                continue
        out.append([line])
    return out


def blocks(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of ``store.PDF_DDL`` of one file; the document's id is the checksum of its path."""
    pdf, doc = Pdf(data), zlib.crc32(path.encode())
    for number, page in enumerate(pdf.pages(), 1):
        box = [float(pdf.at(x)) for x in (pdf.at(page.get("MediaBox")) or [0, 0, 612, 792])]
        for i, block in enumerate(_blocks(_lines(spans(pdf, page)))):
            whole = [s for line in block for s in line]
            lines = [{"spans": [{"text": s.text, "font": s.font, "size": s.size, "flags": s.flags, "origin": {"x": s.x, "y": s.y}} for s in line]} for line in block]
            yield doc, number, i, box[2] - box[0], min(s.x for s in whole), min(s.y for s in whole), max(s.end for s in whole), lines
