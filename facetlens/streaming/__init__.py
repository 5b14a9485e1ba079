from facetlens.streaming.scoring import (  # noqa: F401
    batch_counts, progress_frame, read_stream, run_available, score_stream, windowed_counts)
