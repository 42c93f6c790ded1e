"""One query per operator, over the whole of its table."""

from . import collocations, compression, decontaminate, divergence, jaccard, language, oracles, packing, pii, pivots, quality, secrets, urls, warc
from .book import query
from .common import table, vocabulary


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op2_warc_derivatives", oracles.OP2)
def op2(spark, sf_dir):
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")))


@query("op3_url_filters", oracles.OP3)
def op3(spark, sf_dir):
    return urls.filtered(table(spark, sf_dir, "pages"))


@query("op4_secret_scan")
def op4(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination", oracles.OP5)
def op5(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_pii_deobfuscation")
def op6(spark, sf_dir):
    return pii.search(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return compression.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


@query("op11_exact_top_k", oracles.OP11)
def op11(spark, sf_dir):
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


@query("op12_phrase_collocations", oracles.OP12)
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", oracles.OP13)
def op13(spark, sf_dir):
    return divergence.divergences(table(spark, sf_dir, "documents"))
