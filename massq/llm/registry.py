"""The queries of this subpackage, one for each operator, and their SQL where there is any."""

from massq.llm import audit, bpe, exact, langid, licenses, lm, mixing, near, phrases, quality, rules, simhash, urls

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_lm": lm.query,
    "op3_licenses": licenses.query,
    "op4_rules": rules.query,
    "op5_near": near.query,
    "op6_bpe": bpe.query,
    "op7_quality": quality.query,
    "op8_urls": urls.query,
    "op9_exact": exact.query,
    "op10_langid": langid.query,
    "op11_simhash": simhash.query,
    "op12_audit": audit.query,
    "op13_phrases": phrases.query,
}

SQL = {"op1_mixing": mixing.SQL, "op4_rules": rules.SQL, "op5_near": near.SQL, "op8_urls": urls.SQL, "op9_exact": exact.SQL, "op12_audit": audit.SQL, "op13_phrases": phrases.SQL}
