"""Operations for preparing large text corpora as training data.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the repository top chains five of its operators.
"""
