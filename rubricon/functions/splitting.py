"""Splitting long text into overlapping pieces."""

from __future__ import annotations

from collections import deque

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk size, overlap, and separators from coarse to fine.
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 300
SEPARATORS = ["\n\n", "\n", " ", ""]
# Word windows of the older splitter.
WINDOW_WORDS, WINDOW_OVERLAP = 500, 75


def make_splitter(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=tuple(SEPARATORS)):
    """Recursive character splitter: cut at the coarsest separator
    present, pack neighbouring pieces up to ``size`` characters, carry up to
    ``overlap`` characters into the next chunk. A piece that is too long is cut at the next finer
    separator, and what it gives is packed apart from its neighbours."""

    def pack(run):
        """Chunks of neighbouring pieces."""
        window, held = deque(), 0
        for piece in run:
            if held + len(piece) > size and window:
                chunk = "".join(window).strip()
                if chunk:
                    yield chunk
                while window and (held > overlap or held + len(piece) > size):
                    held -= len(window.popleft())
            window.append(piece)
            held += len(piece)
        chunk = "".join(window).strip()
        if chunk:
            yield chunk

    def split(text, level=0):
        while level < len(separators) - 1 and separators[level] not in text:
            level += 1
        sep = separators[level]
        if sep == "":
            yield from pack(text)
            return
        run = []
        for n, part in enumerate(text.split(sep)):
            part = sep + part if n else part
            if not part:
                continue
            if len(part) < size:
                run.append(part)
                continue
            # Pieces of one level are packed among themselves.
            yield from pack(run)
            run = []
            if level == len(separators) - 1:
                yield part
            else:
                yield from split(part, level + 1)
        yield from pack(run)

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def splitter(text):
        """Row by row: an Arrow batch of long texts would be held whole, with all its chunks."""
        return list(split(text)) if text else []

    return splitter
