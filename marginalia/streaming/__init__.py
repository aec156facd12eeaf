"""No operator here: the workflow is a batch over papers, without windows, watermarks or state."""
