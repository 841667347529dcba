"""Rubrics by the article's style, the note cut and the paragraphs below."""

from lexlake.operators import parsing as pr


def test_finished_articles(spark):
    bodies = [
        ("atx", "\n Scope of \n the act \n\n1. First.\nmore\n2. Second.\n N O T E \n3. gone", "Scope of the act", "\n\n1. First.\nmore\n2. Second."),
        ("atx", "Scope\n1. First.", "Scope", "1. First."),
        ("atx", "1. First.\n(no)", None, "1. First.\n(no)"),
        ("atx", "\n", None, "\n"),
        ("plain", "a\n\n (Scope).\n1. First.", "Scope", "a\n\n1. First."),
        ("plain", "((amended))\n1. First.\n(no)", None, "((amended))\n1. First.\n(no)"),
        ("plain", "a\nb\nc\nd\n(late)", None, "a\nb\nc\nd\n(late)"),
        ("setext", "(no)\ntext", None, "(no)\ntext"),
        ("atx", "N O T E\nx", None, ""),
    ]
    arts = spark.createDataFrame([(7, k, str(k), style, "", body) for k, (style, body, _, _) in enumerate(bodies)], "doc long, article_no long, number string, style string, path string, body string")
    done = pr.finish_articles(arts)
    assert [(r.rubric, r.body) for r in done.orderBy("article_no").collect()] == [b[2:] for b in bodies]
    got = {}
    for r in pr.article_paragraphs(done).orderBy("article_no", "paragraph_no").collect():
        got.setdefault(r.article_no, []).append((r.number, r.text))
    assert got[0] == [("1", "1. First.\nmore"), ("2", "2. Second.")]
    assert got[3] == [(None, "")] and got[4] == [(None, "a"), ("1", "1. First.")] and got[7] == [(None, "(no)\ntext")]
