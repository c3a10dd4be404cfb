"""Weekly text and market signals as Spark jobs.

``functions`` holds column expressions, ``sources`` turns landed records into
posts and bars, ``operators`` are ``DataFrame -> DataFrame`` steps, ``plans``
wires them into the panel, training and report jobs, ``streaming`` applies the
stateless steps to a stream of landed files.
"""
