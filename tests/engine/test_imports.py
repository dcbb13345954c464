"""Nothing but the entry point knows the corpus subpackage, and that one only if it is there."""

import re
from pathlib import Path

ROOT = Path(__file__).parents[2]


def test_no_import_of_the_corpus_subpackage():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+tidelog\.llm|corpus_pipeline", p.read_text(), re.M), p
