"""The queries of this subpackage and their SQL, for the repository's entry point."""

from __future__ import annotations

from zenithal.llm import align, bpe, media, mixing, pfor, pii, pq, quality, quotient, simhash, sortmeans, urlfilter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_token_files": pfor.op4_token_files,
    "op5_pq": pq.op5_pq,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_media": media.op8_media,
    "op9_bpe": bpe.op9_bpe,
    "op10_mixing": mixing.op10_mixing,
    "op11_sort_means": sortmeans.op11_sort_means,
    "op12_exact_dedup": quotient.op12_exact_dedup,
    "op13_alignment": align.op13_alignment,
}
ORACLES = {"op2_warc": warc.ORACLE_SQL, "op6_url_filter": urlfilter.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op11_sort_means": sortmeans.ORACLE_SQL, "op12_exact_dedup": quotient.ORACLE_SQL}
