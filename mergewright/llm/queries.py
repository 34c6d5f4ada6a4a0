"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, media, mixing, neardup, quality, repeats, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_repeats": repeats.query,
    "op3_topk": topk.query,
    "op4_neardup": neardup.query,
    "op5_secrets": secrets.query,
    "op6_mixing": mixing.query,
    "op7_toxicity": toxicity.query,
    "op8_quality": quality.query,
    "op9_media": media.query,
    "op10_bpe": bpe.query,
}
ORACLES = {"op1_sharding": sharding.ORACLE, "op3_topk": topk.ORACLE, "op6_mixing": mixing.ORACLE}
