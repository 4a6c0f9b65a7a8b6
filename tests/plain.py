"""Plain versions of operators that run as Spark expressions, text by text."""


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Fill chunks with consecutive short pieces, carrying at most ``overlap`` characters over."""
    chunks, begin, held = [], 0, 0
    for end, piece in enumerate(pieces):
        if held + len(piece) > size and end > begin:
            chunks.append("".join(pieces[begin:end]).strip())
            while held > overlap or (held > 0 and held + len(piece) > size):
                held -= len(pieces[begin])
                begin += 1
        held += len(piece)
    chunks.append("".join(pieces[begin:]).strip())
    return [c for c in chunks if c]


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Split at the first separator present; pieces still too long are split by the later ones."""
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, later = separators[level], separators[level + 1 :]
    if separator:
        head, *tail = text.split(separator)
        pieces = [p for p in (head, *(separator + t for t in tail)) if p]
    else:
        pieces = list(text)
    chunks, pending = [], []
    for piece in pieces:
        if len(piece) < size:
            pending.append(piece)
            continue
        chunks += _pack(pending, size, overlap)
        pending = []
        chunks += split_recursive(piece, size, overlap, later) if later else [piece]
    return chunks + _pack(pending, size, overlap)
