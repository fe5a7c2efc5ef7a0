"""Queries of the corpus operators, and their SQL where SQL can express them."""

from tabloom.llm import bitplanes, contamination, filter_audit, html_text, licenses, minhash, packing, periodic, quality, sanitise, shuffle, simhash, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_html_extraction": html_text.query,
    "op3_quality_rules": quality.query,
    "op4_license_scan": licenses.query,
    "op5_external_shuffle": shuffle.query,
    "op6_benchmark_decontamination": contamination.query,
    "op7_toxicity_ftrl": toxicity.query,
    "op8_bit_planes": bitplanes.query,
    "op9_pii_sanitisation": sanitise.query,
    "op10_power_of_two_packing": packing.query,
    "op11_periodic_runs": periodic.query,
    "op12_filter_interaction_audit": filter_audit.query,
    "op13_minhash_near_dedup": minhash.query,
}

SQL: dict[str, str] = {"op6_benchmark_decontamination": contamination.SQL, "op12_filter_interaction_audit": filter_audit.SQL}
