"""Training-data operators: ten corpus-scale jobs and the pipeline built from them.

Nothing else in the library imports this subpackage.
"""
