"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import attribution, decontam, langid, linededup, mixing, quotes, simhash, spotsigs, stages, tokenfile, warc


def queries() -> dict:
    return {
        "op1_quotes": quotes.query,
        "op2_warc": warc.query,
        "op3_langid": langid.query,
        "op4_linededup": linededup.query,
        "op5_simhash": simhash.query,
        "op6_spotsigs": spotsigs.query,
        "op7_decontam": decontam.query,
        "op8_mixing": mixing.query,
        "op9_token_orc": tokenfile.query,
        "op10_attribution": attribution.query,
        "pipeline": stages.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_linededup": linededup.SQL, "op7_decontam": decontam.SQL}
