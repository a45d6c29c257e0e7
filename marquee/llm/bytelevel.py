"""The byte-level alphabet in which tokenizer files spell their tokens."""

from __future__ import annotations


def _alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_symbols = _alphabet()


def byte_symbols(text: str) -> str:
    return text.encode().decode("latin-1").translate(_symbols)
