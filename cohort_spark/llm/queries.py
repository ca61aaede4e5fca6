"""The subpackage's queries, with SQL where SQL can express them."""

from cohort_spark.llm import decontamination, interactions, licences, mixing, packing, phrases, quality, substring, topk, toxicity, urls, warc
from cohort_spark.llm.simhash import near_duplicates


def op9_simhash(spark, sf_dir: str):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring": substring.op4_substring,
    "op5_topk": topk.op5_topk,
    "op6_host_rules": quality.op6_host_rules,
    "op7_warc": warc.op7_warc,
    "op8_url_rules": urls.op8_url_rules,
    "op9_simhash": op9_simhash,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": interactions.op11_filter_audit,
    "op12_collocations": phrases.op12_collocations,
    "op13_decontamination": decontamination.op13_decontamination,
}

SQL = {
    "op1_licences": licences.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_substring": substring.OP4_SQL,
    "op5_topk": topk.OP5_SQL,
    "op6_host_rules": quality.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_url_rules": urls.OP8_SQL,
    "op11_filter_audit": interactions.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
