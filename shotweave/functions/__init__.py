"""Column-level building blocks (all JVM-side built-ins, no Python UDFs)."""

from shotweave.functions.rand import draw  # noqa: F401
from shotweave.functions.text import (  # noqa: F401
    STOP_WORDS, clean_chars, regex_tokens, words_of,
)
from shotweave.functions.arrays import argmax, one_hot, softmax  # noqa: F401
