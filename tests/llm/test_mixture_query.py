"""op4 has the position of every copy, in order."""

import random

from tarnlake.llm import mixing
from tarnlake.llm.queries import QUERIES


def test_positions_of_every_copy(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 40))), "en", f"s{k % 3}", None) for k in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() | {"doc_id": r["key"]} for r in mixing.placed(d).collect()]
    query = {r["doc_id"]: r for r in QUERIES["op4_mixture"](spark, str(tmp_path)).collect()}
    for r in got:
        q, at = query[r["doc_id"]], [round(x, 9) for x in r["positions"]] or [None]
        assert (q["taken"], q["copies"], q["first_position"], q["last_position"]) == (r["taken"], r["copies"], at[0], at[-1])
    # the demand target * (t + slope * (t^2 - t)) at each copy's position is the middle of the copy
    own = {r["key"]: r for r in mixing.assign(d).collect()}
    assert len(got) == 150 and max(len(r["positions"]) for r in got) > 1 and min(len(r["positions"]) for r in got) == 0
    for r in got:
        a = own[r["doc_id"]]
        assert len(r["positions"]) == r["copies"]
        for e, t in enumerate(r["positions"]):
            middle = a["place"] + e * a["source_size"] + a["size"] / 2
            assert 0 <= t <= 1 and abs(a["target"] * (t + a["slope"] * (t * t - t)) - middle) < 1e-6 * a["target"]
    first = [(r["positions"][0] if r["positions"] else 2.0, r["doc_id"]) for r in got]
    assert first == sorted(first)
    streamed = sorted((r["doc_id"], r["epoch"], r["position"]) for r in mixing.stream(d).collect())
    assert streamed == sorted((r["doc_id"], e, t) for r in got for e, t in enumerate(r["positions"]))
