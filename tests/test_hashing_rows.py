import hashlib

import numpy as np

from quarry.operators import dense


def test_hashing_encoder_makes_no_row_for_a_token(spark):
    """Signed counts within the row, without an exchange; repeated ids keep their own vectors."""
    texts = ["a b a c a", None, "", "  ", "Zebra zebra é 漢 漢 𝒳", " ".join(f"w{i % 97}" for i in range(3000)), "a b"]
    ids = [1, 2, 3, 4, 5, 6, 1]
    df = spark.createDataFrame(list(zip(ids, texts)), "id bigint, text string")
    for dim in (5, 64):
        out = dense.HashingEncoder(dim, seed=3).encode(df, normalize=False)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
        want = []
        for i, t in zip(ids, texts):
            v = np.zeros(dim)
            for token in (t or "").lower().split():
                h = int(hashlib.md5(f"3:{token}".encode()).hexdigest()[:15], 16)
                v[(h >> 1) % dim] += -1 if h & 1 else 1
            want.append((i, v.tolist()))
        assert sorted((r["id"], r["embedding"]) for r in out.collect()) == sorted(want)
