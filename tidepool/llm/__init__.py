"""Operations of a training-data pipeline, one module each; `entry` registers their queries."""
