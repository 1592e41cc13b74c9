import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that operators use inside: an input that has them too must not clash.
CLASHING = "rid long, pos long, h long, fp long, g long, w0 string, sid long, n_words long, bucket int, part int, length long, row string, who string, t string, m string, p string, found string, anchor long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts): a documents table with ids 0, 1, ..; None stays null."""

    def build(texts, ids=None, langs=None, clash=False):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, langs[k] if langs else "en", f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        schema = COLUMNS
        if clash:
            extra = CLASHING.split(", ")
            rows = [(*r, *("x" if e.endswith("string") else 7 for e in extra)) for r in rows]
            schema = f"{COLUMNS}, {CLASHING}"
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, white space, symbols, ties, repeats, odd code points, and a very long text."""
    long_ = " ".join(f"word{k % 977} and" for k in range(30_000))
    return [
        None, "", " \t\n", "!!! ??? ...", "a", "A a A", "same text here today again", "same text here today again", "SAME  text here\ntoday AGAIN",
        "é" * 50, "漢字かな交じり文 " * 20, "\U0001f600 smile \U0001f600", "x" * 5000, "tab\tand\x00null\x7f", "ß ſ K İ ﬁ", long_, "1234 5678", "<|endoftext|> in a text",
    ]
