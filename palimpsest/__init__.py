"""A Spark-native engine for near-duplicate images and other fingerprinted data."""

#: A release's version; where it is empty, builds are told apart by branch and commit.
__version__ = "0.2.0"
BRANCH, COMMIT = "dev", ""
