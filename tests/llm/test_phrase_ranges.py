"""Bounds of prefix ranges are made where the sample lies."""

from pyspark.sql.classic.dataframe import DataFrame

from threadloom.llm import phrase_automata


def test_driver_gets_bounds_alone(spark, monkeypatch):
    words = ["ab", "b", "a\x01", "é", "zz", "B"]
    texts = [("en" if n % 3 else "de", " ".join(words[(n * k + k // 7) % 6] for k in range(400)) + ". a") for n in range(1, 60)]
    docs = spark.createDataFrame([*texts, ("fr", ""), ("fr", " ., ")], "lang string, text string")
    seen, got = [], []
    for lang, text in texts:
        tokens = next(phrase_automata._pieces(text)).split()
        for at in range(0, len(tokens), phrase_automata.STRIDE):
            window = [*tokens[at : at + phrase_automata.MOST], b"."]
            if window[0] != b".":
                window = window[: window.index(b".")]
                seen.append((lang.encode(), *window, *[b""] * (phrase_automata.MOST - len(window))))
    seen.sort()
    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(rows := real(self)) or rows)
    bounds = phrase_automata.range_bounds(docs, 2048)
    ranges = max(sum(len(t.encode()) for _, t in texts) // 2048, 4)
    assert bounds == sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) and len(bounds) > 5
    assert len(seen) > 300 and sum(map(len, got)) <= ranges + 8  # bounds, and a row for each partition of the sorted sample
    assert phrase_automata.range_bounds(docs.where("lang = 'fr'")) == phrase_automata.range_bounds(docs.limit(0)) == []
