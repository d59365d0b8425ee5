"""Small tables with every awkward case."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; a table may have them as well.
CLASHES = ("id", "d", "t", "k", "n", "h", "key", "pos", "fp", "w", "lines", "copies", "rows", "level", "name", "_h", "_b")
SPACES = "[ \t-\r]"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed: int, n: int = 40, per_line: int = 9) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice("aeiounrstlmd") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + per_line]).capitalize() + "." for i in range(0, n, per_line))


def awkward() -> list[tuple]:
    """NULLs in any column, empty and long texts, ties, repeated rows and copies."""
    texts = [prose(i, 20 + 7 * i) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "en", "s0") for i in range(8)]  # copies
    rows += [(120, texts[1].replace("\n", "  \n\t"), "de", None), (121, texts[1].upper(), None, "s1")]
    rows += [(130, None, None, None), (131, "", "en", "s2"), (132, " \n\t\n ", "en", "s2"), (None, texts[2], "en", "s0"), (None, None, None, None)]
    rows += [(140, texts[3], "en", "s1")] * 3  # rows repeated in full
    rows += [(141, texts[4], "en", "s1"), (141, texts[5] + " x", "en", "s1")]  # one id, two texts
    rows += [(150, prose(99, 6000), "en", "s9"), (151, "word " * 500, "en", "s9"), (152, "ünï😀 " * 30, "fr", "é")]
    return [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]


def frame(spark, rows: list[tuple], clashes: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES}) if clashes else df


def plain(rows) -> list[tuple]:
    """Rows in an order that NULLs and floats allow."""
    return sorted((tuple(r) for r in rows), key=repr)
