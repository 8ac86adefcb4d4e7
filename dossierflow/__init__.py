"""dossierflow: a Spark-native engine for curating and analysing document collections."""

__version__ = "0.1.0"
