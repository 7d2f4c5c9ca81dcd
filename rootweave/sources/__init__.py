"""Sources and sinks: text formats, images, artefacts."""
