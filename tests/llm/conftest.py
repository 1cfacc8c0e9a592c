import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"word{i % 977} filler" for i in range(30_000))
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "one two three four five six", "Straße ÆØÅ 東京 \u00a0x 🙂🙂", "<|endoftext|> a<|endoftext|>b", "</s> <s> <unk>",
    "don't we'll I'm\tx\r\n y  z   ", "1234 567,89 $$$ ***", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "same words here twice", "same words here twice", LONG,
]


CLASHING = ["__t", "__w", "__h", "__g", "__l", "__f", "__q", "judged", "figures", "__key", "__md5", "row", "key", "md5", "node", "word", "__label", "__row", "__id"]


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, a null id, a repeated row, and columns with names the operators use inside."""
    rows = [(i, t, "en", "s1", len(t or ""), 0.5, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id here", None, None, None, None, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, __text string")
    # names that operators use inside or once used
    return df.selectExpr("*", *[f"'mine' AS `{n}`" for n in CLASHING])


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
