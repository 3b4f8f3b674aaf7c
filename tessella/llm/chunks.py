"""Chunks: pieces of a text that the byte-level pre-token pattern never splits across.

In a text whose white space is single blanks and single line feeds between other characters, every blank opens the
pre-token that follows it and every line feed is a pre-token of its own. Such a text is therefore cut at each of them
without the pattern, and a chunk's tokens are cached whole. Any other text is cut by the pattern itself.

A key stands for one chunk: ``\\r`` + the raw piece, or a piece that starts with ``\\n``, or a word that a blank precedes.
"""

from __future__ import annotations

import regex
from public_tokenizers import PATTERN

PRE_TOKEN = regex.compile(PATTERN)


def chunk_keys(text: str) -> list[str]:
    if not text:
        return []
    if " ".join(text.split()) != text.replace("\n", " "):
        return ["\r" + piece for piece in PRE_TOKEN.findall(text)]
    return ("\r" + text.replace("\n", " \n")).split(" ")


def chunk_text(key: str) -> str:
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key
