from facetlens.sources.readers import (  # noqa: F401
    explode_lines, flatten_reviews, global_rank, intake_filter, load_table, project_result,
    read_lines, read_parts, read_reviews, read_text_fallback, resolve_text_column, resume_anti,
    resume_from, union_parts, with_text)
from facetlens.sources.sinks import export_csv, nest_aspects, write_results  # noqa: F401
