"""Recursive text splitting: cut at the coarsest separator there is, and only pieces still too long at finer ones."""

from __future__ import annotations

# Fixed values, from coarse to fine; the empty one cuts between all characters.
SEPARATORS = (
    "\n\n", "\n# ", "\n## ", "\n### ", "\n#### ", "\n- ", "\n* ", "\n+ ", "```\n", "\n---\n", "\n___\n", "\n***\n",
    "\n", ". ", "! ", "? ", "; ", ": ", ",", "。", "．", "、", " ", "",
)
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100


def clamp_overlap(size: int, overlap: int) -> int:
    """An overlap that isn't smaller than the chunks becomes a quarter of them."""
    return overlap if overlap < size else max(0, size // 4)


def engine_limits(size: int, overlap: int, least: int) -> tuple[int, int, int]:
    """Chunk size, overlap and least length as an engine accepts them."""
    size = max(1, size)
    return size, max(0, min(overlap, size // 2)), max(0, least)


def cut_at(text: str, separator: str) -> list[str]:
    """Pieces that start with the separator, apart from the first; no empty ones."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *(separator + p for p in others)) if p]


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined to chunks of at most ``size``; the last parts of a chunk, up to ``overlap``, start the next one."""
    out, held, total = [], [], 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [chunk for chunk in out if chunk]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out, small = [], []
    for piece in cut_at(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += packed(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + packed(small, size, overlap)
