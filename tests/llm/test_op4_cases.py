"""Endpoints by every name and separator, and opaque tokens of any length."""

from test_operators import docs_of

from pagewright.llm import secrets

KEY = "AKIA" + "ABCDEFGH12345678"
OPAQUE = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1a"


def linked(spark, texts):
    found = secrets.scan(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    keys = {r.key: r.doc_id for r in found.collect()}
    out = {i: set() for i in range(len(texts))}
    for r in secrets.credentials(found).collect():
        out[keys[r.key]] |= {(x.kind, texts[keys[r.key]][x.start : x.end]) for x in (r.a, r.b, r.c) if x}
    return out


def test_endpoint_names_take_separators(spark):
    forms = [(f"{name}{sep}db.example.com", True) for name in ("host", "Endpoint", "SERVER") for sep in (": ", " = ", '": "', "=")]
    forms += [("https://db.example.com", True), ("hostname", False), ("endpoints", False), ("host db.example.com", False)]
    got = linked(spark, [f'{KEY} {OPAQUE} "{form}"' for form, _ in forms])
    for i, (form, yes) in enumerate(forms):
        assert {x for k, x in got[i] if k == "endpoint"} == ({form} if yes else set())


def test_long_opaque_tokens(spark):
    sizes = (31, 32, 128, 129, 300, 5000)
    tokens = [("aB3" * n)[:n] for n in sizes]
    got = linked(spark, [f"{KEY} {t} end" for t in tokens])
    assert [{x for k, x in got[i] if k == "opaque"} for i in range(len(sizes))] == [set() if n < 32 else {t} for n, t in zip(sizes, tokens, strict=True)]
