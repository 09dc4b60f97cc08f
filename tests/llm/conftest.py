from __future__ import annotations

import pytest

#: White space of all kinds, contractions, marks, other scripts, special-token text, and very long texts.
NASTY = [
    "", " ", "\n", "  \n \t ", "a  b   c\n\n d \n\n\n e", "It's they'll WE'VE 'quoted' don''t", "x y   z　w\u0085v",
    "naïve Ünïcode 漢字 かな 🎉🎉 ́e", "12 345,6 #tag $5 %&|<>*", "<|endoftext|> and <|im_start|>", "tab\tsep\r\nline\r\n",
    "\x1c\x1d \x1e \x1f", "end with space ", " start", "a\n b \n c", "word " * 30_000, "z" * 50_000, "é" * 3, "the same line\n" * 40,
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and keys, and names that clash with inner ones."""
    rows = [(i, t, "en", f"s{i % 5}", len(t), "r", 1, i) for i, t in enumerate(NASTY)]
    rows += [(3, "the same key, another text that is here", "en", "s1", 1, "r", 1, 3)] + [rows[8], rows[8]]
    rows += [(None, "no key but a text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
             (100, None, "fr", "s2", 0, "x", 2, 5), (101, "naïve Ünïcode 漢字 かな 🎉🎉 ́e", None, "s3", 3, "y", 3, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, "
                                       "size int, key long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
