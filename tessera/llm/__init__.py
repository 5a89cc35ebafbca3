"""Operations of a large-scale training-data pipeline, on DataFrames.

Nothing else in the library imports this subpackage; ``queries`` registers its queries.
"""
