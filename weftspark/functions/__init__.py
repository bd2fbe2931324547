"""Column functions of the operators, in one place."""

from weftspark.operators.corpus import content_id, content_type, estimate_tokens, shingles, words
from weftspark.operators.emit import name_triples, pattern_triples, report_triples
from weftspark.operators.evaluate import category, client_ip, instruction, overall, rate_pct, set_differences, set_precision, set_recall, source_recall, token_cost, valid_query
from weftspark.operators.extract import needs_model, resolve_id
from weftspark.operators.graph import label, relation
from weftspark.operators.netlist import cell_type, repair_names
from weftspark.operators.prompts import answer_of, judge_prompt, parsed, question_prompt, unfenced
from weftspark.operators.reports import area_report, cell_kind, die_area, frequency, power_report, sdc_variant, timing_report
from weftspark.operators.retrieve import citations, clamp, context, handler, shown_score
from weftspark.operators.runs import area_of, area_summary, design_name, json_stats, power_of, power_summary, timing_stats, timing_summary
from weftspark.operators.search import overlap_score, terms

__all__ = [
    "answer_of", "area_of", "area_report", "area_summary", "category", "cell_kind", "cell_type", "citations", "clamp", "client_ip", "content_id", "content_type", "context", "design_name", "die_area", "estimate_tokens", "frequency", "handler",
    "instruction", "json_stats", "judge_prompt", "label", "name_triples", "needs_model", "overall", "overlap_score", "parsed", "pattern_triples", "power_of", "power_report", "power_summary", "question_prompt", "rate_pct", "relation", "repair_names", "report_triples",
    "resolve_id", "sdc_variant", "set_differences", "set_precision", "set_recall", "shingles", "shown_score", "source_recall", "terms", "timing_report", "timing_stats", "timing_summary", "token_cost", "unfenced", "valid_query", "words",
]
