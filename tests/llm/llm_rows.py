"""Rows that every operator must bear, and brute-force helpers."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, fp long, "
          "leak string, rules string, pii string, bpe string, h long, c long, k1 long, rank int, license string, stats string")
PROSE = ("The quick brown fox jumps over the lazy dog while seven wizards quietly examine vexing bronze puzzles near a "
         "frozen jungle river, hoping that nobody will notice how strange their evening work has become lately.")


def row(doc_id, text):
    return (doc_id, text, "en", "src0", len(text or ""), *[None] * 13)


ODD = [
    row(None, None), row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one"), row(5, PROSE), row(5, PROSE), row(6, PROSE),
    row(7, PROSE.replace("seven", "eight")), row(8, "é ß \U0001d5ba \U0001f600 \x00 中文"), row(9, "word " * 30000),
    row(10, "\n".join(f"line {i % 7} of a long text number {i * i}" for i in range(3000))), row(None, PROSE)]


def by_row(df, *cols):
    """Sorted tuples, in a form that can hold nulls."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
