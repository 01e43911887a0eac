"""Readers whose input is no table: a matrix of bytes, a paged service, a service of typed items."""

import numpy as np


def test_imported_matrix(spark, tmp_path):
    from almanack.sources.store import import_matrix

    rows = [[x * 10, x * 10 + 1, 0] for x in range(40)]
    for f in range(3):
        (tmp_path / f"m-{f:03d}.f32").write_bytes(np.array(rows[16 * f : 16 * f + 16], "<f4").tobytes())
    ids = spark.range(40).where("id % 3 <> 0").selectExpr("id AS row", "id")
    got = {r.id: list(r.vector) for r in import_matrix(spark, f"file://{tmp_path}", ids, 3).collect()}
    assert got == {x: rows[x] for x in range(40) if x % 3}


def test_paged_service():
    from almanack.sources import web as B

    def fetch(url):
        at = int(url.split("=")[1])
        return 200, {"items": list(range(at, min(at + 10, 95)))} | ({"continue": at + 10} if at + 10 < 95 else {})

    pages = B.paged(fetch, lambda token: f"?at={token or 0}", B.Patience(sleep=lambda s: None))
    assert [x for p in pages for x in p["items"]] == list(range(95))


def test_typed_items_fall_back_to_decades():
    from almanack.sources import web as B

    found = B.typed_items(lambda q: (500, None), "Q3305213", 1995, 2004, 10, B.Patience(sleep=lambda s: None), lambda d: [f"decade {d}"])
    assert found == ["decade 1990", "decade 2000"]
