"""Operations of a training-data pipeline.

Nothing else in the library imports this subpackage.  ``queries`` in
``reelframe.llm.registry`` lists one query for each operator.
"""
