"""Leader classification, merging and the coding of symbol dictionaries and text regions, for the shapes of one document."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from inkplan.functions import mq, segments, shapes
from inkplan.plans.options import Encoding


@dataclass
class Shape:
    page: int
    x: int
    y: int
    bits: np.ndarray
    area: int
    cx: np.float32
    cy: np.float32
    kind: int = -1
    left: int = 0
    top: int = 0


def shapes_of(page_no: int, page: np.ndarray) -> list[Shape]:
    found = shapes.component_table([page])
    return [Shape(page_no, *row) for row in zip(found["x"].tolist(), found["y"].tolist(), found["bits"], found["area"].tolist(), found["cx"], found["cy"], strict=True)]


@dataclass
class Classes:
    """Templates of a document so far; a shape that correlates with none becomes one. Kept between pages of a stream."""

    threshold: float
    weight: float
    templates: list[Shape] = field(default_factory=list)
    by_size: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    members: list[Shape] = field(default_factory=list)
    #: Bitmaps that matched a template of their own size: templates that come later can't be found before it.
    known: dict[tuple[int, int, bytes], int] = field(default_factory=dict)

    def match(self, shape: Shape) -> int:
        h, w = shape.bits.shape
        for dx, dy in shapes.WALK:
            for i in self.by_size.get((w + dx, h + dy), ()):
                other = self.templates[i]
                need = math.ceil(math.sqrt(shapes.threshold_for(self.threshold, self.weight, other.area, other.bits.size) * shape.area * other.area))
                if min(shape.area, other.area) >= need and shapes.overlap(shape.bits, other.bits, shapes.away(shape.cx - other.cx), shapes.away(shape.cy - other.cy)) >= need:
                    return i
        return -1

    def add_page(self, page_no: int, page: np.ndarray) -> None:
        own = shapes_of(page_no, page)
        for shape in own:
            name = (*shape.bits.shape, shape.bits.tobytes())
            shape.kind = self.known.get(name, -1)
            if shape.kind >= 0:
                continue
            shape.kind = self.match(shape)
            if shape.kind < 0:
                shape.kind = len(self.templates)
                self.templates.append(shape)
                self.by_size.setdefault(shape.bits.shape[::-1], []).append(shape.kind)
                if self.match(shape) == shape.kind:
                    self.known[name] = shape.kind
            elif self.templates[shape.kind].bits.shape == shape.bits.shape:
                self.known[name] = shape.kind
        # the same template over the same pixels is placed alike
        moves: dict[tuple[int, bytes], tuple[int, int]] = {}
        for shape in own:
            template = self.templates[shape.kind]
            x, y = shape.x - shapes.away(template.cx - shape.cx), shape.y - shapes.away(template.cy - shape.cy)
            under = shapes.window(page, x, y, template.bits)
            if (move := moves.get(name := (shape.kind, under.tobytes()))) is None:
                move = moves[name] = shapes.best_shift(under, template.bits)
            shape.left, shape.top = x + move[0], y + move[1]
        self.members += own

    def renumber(self, new: list[int], templates: list[Shape]) -> None:
        for shape in self.members:
            shape.kind = new[shape.kind]
        self.templates = templates

    def merge_all(self) -> None:
        """Each template takes in the equivalent ones after it; the last template fills a gap and is looked at next."""
        slots, goes = list(range(len(self.templates))), list(range(len(self.templates)))
        i = 0
        while i < len(slots):
            j = i + 1
            while j < len(slots):
                if shapes.equivalent(self.templates[slots[i]].bits, self.templates[slots[j]].bits):
                    goes[slots[j]] = slots[i]
                    last = slots.pop()
                    if j < len(slots):
                        slots[j] = last
                else:
                    j += 1
            i += 1
        place = {t: p for p, t in enumerate(slots)}
        self.renumber([place[goes[t]] for t in range(len(goes))], [self.templates[t] for t in slots])

    def merge_blocks(self) -> None:
        """As merge_all, but only templates of one block meet, and those that stay keep their order."""
        blocks: dict[int, list[int]] = {}
        for i, t in enumerate(self.templates):
            blocks.setdefault(shapes.block_of(t.bits), []).append(i)
        goes = list(range(len(self.templates)))
        for block in blocks.values():
            while block:
                first, *rest = block
                block = []
                for i in rest:
                    if shapes.equivalent(self.templates[first].bits, self.templates[i].bits):
                        goes[i] = first
                    else:
                        block.append(i)
        stay = [i for i in range(len(goes)) if goes[i] == i]
        place = {t: p for p, t in enumerate(stay)}
        self.renumber([place[g] for g in goes], [self.templates[t] for t in stay])


def dictionary_order(templates: list[Shape], chosen: list[int]) -> list[int]:
    """By height, width, then the order given."""
    return sorted(chosen, key=lambda t: templates[t].bits.shape)


def code_dictionary(templates: list[Shape], chosen: list[int]) -> tuple[bytes, dict[int, int]]:
    """The coded dictionary, and the number of each template in it."""
    stream, order, height, width = mq.Stream(), dictionary_order(templates, chosen), 0, 0
    for k, t in enumerate(order):
        h, w = templates[t].bits.shape
        if not k or h != height:
            if k:
                stream.integer("IADW", None)
            stream.integer("IADH", h - height)
            height, width = h, 0
        stream.integer("IADW", w - width)
        width = w
        stream.add(mq.region(templates[t].bits))
    if order:
        stream.integer("IADW", None)
    stream.integer("IAEX", 0)
    stream.integer("IAEX", len(order))
    return stream.coded(), {t: k for k, t in enumerate(order)}


def code_text(members: list[Shape], numbers: dict[int, int], widths: dict[int, int], heights: dict[int, int], bits: int) -> bytes:
    """members: the shapes of a page in order of discovery; strips are a pixel high."""
    placed = sorted(((s.top + heights[s.kind] - 1, s.left, i) for i, s in enumerate(members)))
    stream, strip, first, at = mq.Stream(), None, 0, 0
    stream.integer("IADT", 0)
    for y, x, i in placed:
        if y != strip:
            if strip is not None:
                stream.integer("IADS", None)
            stream.integer("IADT", y - (strip or 0))
            stream.integer("IAFS", x - first)
            strip, first = y, x
        else:
            stream.integer("IADS", x - at)
        kind = members[i].kind
        if kind not in numbers:
            raise ValueError(f"symbol {kind} is in no dictionary")
        stream.add(mq.symbol_id(bits, numbers[kind]))
        at = x + widths[kind] - 1
    stream.integer("IADS", None)
    return stream.coded()


def bits_for(count: int) -> int:
    return max(0, count - 1).bit_length()


def assemble(classes: Classes, pages: list[tuple[int, int, int, int]], options: Encoding) -> tuple[bytes | None, list[bytes]]:
    """Globals (None if empty) and one stream per page. pages: width, height, x dpi, y dpi of pages 0, 1, ..."""
    if not pages:
        raise ValueError("a document needs at least one page")
    if options.merge:
        classes.merge_blocks() if options.merge_by_hash else classes.merge_all()
    templates, members = classes.templates, classes.members
    uses = np.bincount([s.kind for s in members], minlength=len(templates)).tolist()
    shared = [t for t, n in enumerate(uses) if n > 1 or len(pages) == 1]
    widths, heights = ({t: s.bits.shape[k] for t, s in enumerate(templates)} for k in (1, 0))
    number, numbers, refers = 0, {}, ()
    out = segments.file_header(len(pages)) if options.full else b""
    if shared:
        coded, numbers = code_dictionary(templates, shared)
        out += segments.segment(0, segments.SYMBOLS, 0, segments.symbol_dictionary(len(shared), coded), retain=1)
        number, refers = 1, (0,)
    streams = []
    for p, (width, height, x_dpi, y_dpi) in enumerate(pages):
        page = p + 1 if options.full else 1
        own = [s for s in members if s.page == p]
        parts = [segments.segment(number, segments.PAGE, page, segments.page_information(width, height, x_dpi, y_dpi, False))]
        number += 1
        if own:
            local, known, seen = [s.kind for s in own if uses[s.kind] == 1 and len(pages) > 1], dict(numbers), refers
            if local:
                coded, places = code_dictionary(templates, local)
                parts.append(segments.segment(number, segments.SYMBOLS, page, segments.symbol_dictionary(len(local), coded), retain=1))
                known |= {t: k + len(numbers) for t, k in places.items()}
                seen = (*refers, number)
                number += 1
            coded = code_text(own, known, widths, heights, bits_for(len(shared) + len(local)))
            parts.append(segments.segment(number, segments.TEXT, page, segments.text_region(width, height, len(own), coded), seen, 2 if refers else 0))
            number += 1
        if options.full:
            parts.append(segments.segment(number, segments.END_OF_PAGE, page))
            number += 1
            if p == len(pages) - 1:
                parts.append(segments.segment(number, segments.END_OF_FILE, 0))
                number += 1
        streams.append(b"".join(parts))
    return out or None, streams


def lossless(page: np.ndarray, x_dpi: int, y_dpi: int, options: Encoding) -> bytes:
    """One page as a generic region."""
    coded = mq.Stream()
    coded.add(mq.region(page, options.duplicate_lines))
    height, width = page.shape
    out = segments.segment(0, segments.PAGE, 1, segments.page_information(width, height, x_dpi, y_dpi, True))
    out += segments.segment(1, segments.GENERIC, 1, segments.generic_region(width, height, options.duplicate_lines, coded.coded()))
    if options.full:
        out = segments.file_header(1) + out + segments.segment(2, segments.END_OF_PAGE, 1) + segments.segment(3, segments.END_OF_FILE, 0)
    return out
