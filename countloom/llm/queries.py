"""The queries of this subpackage and their SQL."""

from countloom.llm import debruijn, decontaminate, jpeg, langid, minhash, mixing, oracles, sharding, suffixes, toxicity, urls


def queries():
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_media": jpeg.op3_media,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language": langid.op5_language,
        "op6_debruijn": debruijn.op6_debruijn,
        "op7_urls": urls.op7_urls,
        "op8_sharding": sharding.op8_sharding,
        "op9_mixing": mixing.op9_mixing,
        "op10_suffixes": suffixes.op10_suffixes,
    }


def oracle_sql():
    return {"op1_minhash": oracles.MINHASH, "op4_decontaminate": oracles.DECONTAMINATE, "op6_debruijn": oracles.DEBRUIJN, "op7_urls": urls.ORACLE}
