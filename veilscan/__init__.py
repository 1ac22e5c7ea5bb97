"""PII scanning of tables, files and streams as Spark plans."""

from veilscan.functions.labels import label_packs, resolve_labels
from veilscan.operators.model_scorer import ModelScorer, file_tokenizer, onnx_model
from veilscan.operators.model_files import load_scorer
from veilscan.operators.pattern_scorer import PatternRule, PatternScorer
from veilscan.operators.rule_tables import judge_by_table
from veilscan.plans.report import entity_rows, report, report_rows, summarise
from veilscan.plans.scan import Scanner, scan_table
from veilscan.settings import Settings, merge_settings
from veilscan.sources.files import scan_directory, scan_file, scan_files, scan_path
from veilscan.sources.sinks import write_response
from veilscan.streaming.landing import scan_stream

__all__ = [
    "ModelScorer",
    "PatternRule",
    "PatternScorer",
    "Scanner",
    "Settings",
    "entity_rows",
    "file_tokenizer",
    "judge_by_table",
    "label_packs",
    "load_scorer",
    "merge_settings",
    "onnx_model",
    "report",
    "report_rows",
    "resolve_labels",
    "scan_directory",
    "scan_file",
    "scan_files",
    "scan_path",
    "scan_stream",
    "scan_table",
    "summarise",
    "write_response",
]
