"""The queries opN_<name> and their SQL, for `__spark_entry__.py`."""

from __future__ import annotations

from veilspark.llm import ann_bits, chat_format, decontaminate, jaccard_join, langid, line_dedup, pii_labelers, secret_scan, sentencepiece_viterbi, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_sentencepiece": sentencepiece_viterbi.op2_sentencepiece,
    "op3_pii_labelers": pii_labelers.op3_pii_labelers,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_ann_bits": ann_bits.op5_ann_bits,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_langid": langid.op10_langid,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op5_ann_bits": ann_bits.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
