"""Plain versions of common parts, for comparison."""

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, pairs):
    """{node: smallest node it is connected with}."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def docs_of(spark, texts, **extra):
    """A documents table of texts or (doc_id, text, source) rows."""
    rows = [(i, t, "en", "s", None) if not isinstance(t, tuple) else (t[0], t[1], "en", t[2], None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
