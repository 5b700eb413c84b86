"""Notices that no single line holds."""

import textwrap

from wardspark.llm import licenses


def test_wrapped_notices(spark):
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        for width in (20, 40, 70):
            for margin in ("", "# ", " * ", "rem "):
                k = len(rows)
                rows.append((k, "some prose here\n\n" + textwrap.fill(text, width, initial_indent=margin, subsequent_indent=margin) + "\n\nand more of it"))
                want[k] = label if margin != "rem " or width > 20 else None
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        assert label is None or label in got[k].labels.split(","), rows[k]
        assert label is None or got[k].score >= 0.8


def test_words_that_are_scattered_are_no_notice(spark):
    """All words of a template, far apart, in two texts and in one."""
    words = licenses.TEMPLATES[1][1].split()
    far = "\n".join(w + " x y z" for w in words)
    rows = [(1, far), (2, " ".join(words[:10])), (3, "\n".join(words[10:]))]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [r.labels for r in got] == ["", "", ""]
