"""Training-data operators: fingerprints, packing, filters, chat formatting and token storage.

Nothing outside this package imports it.  Shared rules of all operators:

* a null text counts as the empty text, a null ``doc_id`` is an id of its own
  that sorts before all others, and repeated rows give repeated result rows;
* extra input columns are ignored unless the operator returns its input rows;
* an empty table gives an empty result with the same schema.
"""
