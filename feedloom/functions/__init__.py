"""Part of feedloom; see the modules."""
