"""txrisk: transaction-risk analytics on Spark.

Load and validate transactions, clean and pseudonymize them, derive the 58
risk features (``plans.chain.FeatureChain``), split exactly by class
(``operators.split``), train tree ensembles (``operators.models``), compute
exact metrics (``operators.metrics``) and per-row attributions
(``operators.explain``). ``plans.jobs`` chains these into end-to-end jobs.
"""

__version__ = "0.1.0"
