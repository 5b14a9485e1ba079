"""facetlens: aspect-level opinion analytics as Spark DataFrame jobs.

Sub-packages:
  sources    -- readers, intake gates and sinks for review tables and files
  functions  -- Column-level text functions (cleaning, markers, whole-word match)
  operators  -- DataFrame operators: clauses, parsing, language, classifiers,
                metrics, agreement, reporting
  plans      -- pair frames and composed batch runs built from the operators
  streaming  -- Structured Streaming scoring and windowed counts
"""

from facetlens.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
