import numpy as np
import pyarrow as pa

from lociflow.llm import neardup


def test_first_shared_band_is_told_by_keys_not_by_low_bytes():
    """Band 2 agrees in its low bytes only; bands 3 and 4 are truly shared, and the pair is compared once, in band 3."""
    shape = (2, neardup.ROWS * neardup.BANDS)
    high = np.random.default_rng(1).integers(0, 1 << 14, shape, dtype=np.uint32) << np.uint32(8)
    high[:, 18:30] = high[:1, 18:30]
    signed = high | np.arange(shape[1], dtype=np.uint32) % np.uint32(256)
    signed[1, :12] ^= np.uint32(1)
    keys = neardup.band_keys(signed)
    assert (keys[0] == keys[1]).nonzero()[0].tolist() == [3, 4]
    shingles = np.arange(100, dtype=np.uint64).tobytes()
    columns = {
        "cid": [1, 2], "component": [1, 2], "n": [100, 100], "side": [0, 0], "lo": [0, 0], "hi": [0, 0], "shingles": [shingles] * 2,
        "low": [x.tobytes() for x in signed.astype(np.uint8)], "checks": [x.tobytes() for x in keys.astype(np.uint32)],
    }
    found = []
    for band in (3, 4):
        batch = pa.RecordBatch.from_pydict(columns | {"key": [int(keys[0, band])] * 2, "band": [band] * 2})
        found += [r for b in neardup._across(75)(iter([batch])) for r in b.to_pylist()]
    assert found == [{"a": 1, "b": 2}]
