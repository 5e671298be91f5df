"""The media feature against brute force over all neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from verbatlas.llm import jpeg, media


def brute(body: bytes) -> str:
    rgb = np.concatenate(list(jpeg.strips(jpeg.decode(body)))).astype(int)
    high, wide = rgb.shape[:2]
    out = []
    for c in range(3):
        steps = sum(abs(int(a) - int(b)) for row in rgb[..., c] for a, b in zip(row[1:], row[:-1]))
        out.append("%.3f,%.3f" % (rgb[..., c].sum() / (high * wide), steps / (high * (wide - 1))))
    return f"{wide}x{high};" + ";".join(out)


@pytest.mark.parametrize("narrower", [0, 1])
def test_feature_covers_all_neighbours(narrower):
    body = jpeg.encode_bytes(np.random.default_rng(5).integers(0, 256, 64 * 24, np.uint8).tobytes())
    at = body.index(b"\xff\xc2") + 7
    wide = int.from_bytes(body[at : at + 2], "big")
    body = body[:at] + (wide - narrower).to_bytes(2, "big") + body[at + 2 :]
    assert media.feature(body) == brute(body)


def test_chroma_steps_count():
    """Luma all alike, chroma different from block to block: the steps are those of the chroma."""
    payload = np.zeros((24, 64), np.uint8)
    payload[:, 0] = 128
    payload[16:, 0] = np.random.default_rng(6).integers(128, 256, 8)
    body = jpeg.encode_bytes(payload.tobytes())
    rgb = np.concatenate(list(jpeg.strips(jpeg.decode(body)))).astype(int)
    assert np.abs(np.diff(rgb, axis=1))[:, 1::2].any() and media.feature(body) == brute(body)
