"""folia: document-corpus analytics on Spark."""
