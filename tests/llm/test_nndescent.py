"""Links of a large label against brute force: lone pairs just over the threshold, and a group larger than any list."""

import numpy as np
import pyarrow as pa

from tessera.llm import nndescent


def planted(n=40_000, pairs=3000, width=64):
    """``pairs`` lone pairs of cosine 0.93 to 0.945, 60 vectors around one centre, and random ones."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, width)))
    a, off = x[:pairs], unit(rng.standard_normal((pairs, width)))
    off = unit(off - (off * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9301, 0.945, (pairs, 1))
    x[pairs : 2 * pairs] = cos * a + np.sqrt(1 - cos * cos) * off
    x[2 * pairs : 2 * pairs + 60] = unit(x[2 * pairs] + 0.26 * unit(rng.standard_normal((60, width))))
    return x.astype(np.float32)


def test_links_of_a_large_label(spark):
    x = planted()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(unit[at : at + 1000] @ unit.T >= 0.93).sum(axis=1) for at in range(0, len(x), 1000)]) - 1
    rows = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.zeros(len(x), np.int32))})
    got = {r["vec_id"]: r["n_links"] for r in nndescent.near_duplicates(spark.createDataFrame(rows)).collect()}
    lost = sum(int(n) - got[k] for k, n in enumerate(want))
    assert want[:6000].sum() >= 6000 and lost == 0, f"{lost} of {want.sum()} link ends lost"


def test_one_link_between_two_groups(spark):
    """Both ends of the link that joins the groups have more, nearer links than a list holds."""
    rng = np.random.default_rng(5)
    at = np.radians([0.0, 21.0, *rng.uniform(-5, -2.5, 40), *rng.uniform(23.5, 26, 40)])
    x = np.zeros((len(at), 16))
    x[:, 0], x[:, 1] = np.cos(at), np.sin(at)
    x[2:, 2:] += 1e-3 * rng.standard_normal((len(at) - 2, 14))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert want[:2].tolist() == [41, 41] and (want[2:] == 40).all()
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(df).collect()}
    assert got == {k: (int(n), 0) for k, n in enumerate(want)}
