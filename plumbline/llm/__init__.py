"""Training-data operators: ten dealt operators, each in a module of its own.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin ``opN_<name>`` queries; the modules hold the operators.
"""
