"""The queries of this subpackage, and SQL for those that SQL can express."""

from cadenza.llm import ann, divergence, media, mixing, ngram_join, packing, quality, repair, sharding, simhash, sitetree, suffix_dedup, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_media": media.op2_media,
    "op3_sharding": sharding.op3_sharding,
    "op4_ann": ann.op4_ann,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_sitetree": sitetree.op7_sitetree,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_simhash": simhash.op11_simhash,
    "op12_repair": repair.op12_repair,
    "op13_divergence": divergence.op13_divergence,
}

SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
