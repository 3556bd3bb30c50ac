"""The queries of this package and their SQL."""

from __future__ import annotations

from . import caps, fingerprints, jaccard, mixing, packing, quality, secrets, token_files, toxicity, warc

QUERIES = {
    "op1_syncmers": fingerprints.op1_syncmers,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_warc": warc.op3_warc,
    "op4_caps": caps.op4_caps,
    "op5_pack": packing.op5_pack,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_token_files": token_files.op8_token_files,
    "op9_secrets": secrets.op9_secrets,
    "op10_jaccard": jaccard.op10_jaccard,
}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_caps": caps.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}
