"""The registered queries of the training-data operators and their SQL."""

from . import audit, binary, embeddings, html, language, licenses, manifest, minhash, mixing, packing, quality, rules, substring

QUERIES = {
    "op1_binary": binary.op1_binary,
    "op2_quality": quality.op2_quality,
    "op3_language": language.op3_language,
    "op4_packing": packing.op4_packing,
    "op5_rules": rules.op5_rules,
    "op6_html": html.op6_html,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_substring": substring.op8_substring,
    "op9_mixing": mixing.op9_mixing,
    "op10_minhash": minhash.op10_minhash,
    "op11_audit": audit.op11_audit,
    "op12_licenses": licenses.op12_licenses,
    "op13_manifest": manifest.op13_manifest,
}

ORACLE_SQL = {
    "op9_mixing": mixing.SQL,
    "op11_audit": audit.SQL,
    "op12_licenses": licenses.SQL,
    "op13_manifest": manifest.SQL,
}
