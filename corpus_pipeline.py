"""A training corpus from raw documents: five stages, each written and read again by the next. The code is in the subpackage."""

from tidelog.llm.pipeline import (
    ORACLE_SQL,
    PASSAGE_STAGES,
    STAGES,
    remove_repeated_passages,
    run,
    run_passages,
)

__all__ = ["ORACLE_SQL", "PASSAGE_STAGES", "STAGES", "remove_repeated_passages", "run", "run_passages"]
