import textwrap

from clipgrain.llm import licenses


def test_wrapped_and_embedded_notices(spark):
    code = [f"def f{i}(x): return x + {i} * y{i}" for i in range(60)]
    texts = ["\n".join([*code[:9], *(f" * {x}" for x in textwrap.wrap(body, 60)), *code[9:]]) for _, body in licenses.TEMPLATES[:5]]
    prose = " ".join(f"word{i}" for i in range(80))
    texts += [f"{prose} Copyright 2020 Somebody. All rights reserved. {prose} Licensed under CC BY 4.0. {prose}", prose, "Under CC BY 4.0."]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), runs=True).collect():
        got.setdefault(r["doc_id"], set()).add((r["line"], r["template"], r["dice"]))
    for i in range(5):
        assert (10, i, 1.0) in got[i], (i, got.get(i))
    assert got[5] == {(1, 14, 1.0), (1, 10, 1.0)}
    assert 6 not in got and {t for _, t, _ in got[7]} == {10}
