"""Fixed word lists shipped with the package (plain text, one entry per line)."""

from __future__ import annotations

import functools
import os

_DIR = os.path.join(os.path.dirname(__file__), "resources")


@functools.lru_cache(maxsize=None)
def word_list(name: str) -> tuple[str, ...]:
    with open(os.path.join(_DIR, name), encoding="utf-8") as fh:
        return tuple(w.strip() for w in fh if w.strip())


def stop_words() -> tuple[str, ...]:
    """English stop words: Apache Spark's default StopWordsRemover list."""
    return word_list("stopwords_en.txt")
